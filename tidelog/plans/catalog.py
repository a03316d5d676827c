"""All queries of the engine by name, and DuckDB SQL for the same rows."""

from tidelog.functions import catalog as functions
from tidelog.ml import catalog as ml
from tidelog.operators import relational, statements
from tidelog.plans import datalog, graph, streams
from tidelog.sources import formats

PARTS = (datalog, relational, statements, functions, graph, streams, formats, ml)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
