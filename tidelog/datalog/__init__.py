"""Datalog programs on Spark: rules are compiled to DataFrames, recursion runs to a fixpoint."""

from tidelog.datalog.session import DatalogSession, Program

__all__ = ["DatalogSession", "Program"]
