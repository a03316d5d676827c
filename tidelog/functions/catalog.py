"""Scalar functions by family. Each maps a name to (Spark SQL, DuckDB SQL) over one table; None: no DuckDB equivalent.

Those without one are in a query of their own, without SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: family: table, key, functions
FAMILIES: dict[str, tuple[str, str, dict[str, tuple[str, str | None]]]] = {
    "math": (
        "part",
        "p_partkey",
        {
            name: (sql, sql)
            for name, sql in {
                "abs": "abs(p_size - 25)", "acos": "acos(p_size / 100.0D)", "asin": "asin(p_size / 100.0D)", "atan": "atan(p_size)", "atan2": "atan2(p_size, 3)",
                "cbrt": "cbrt(p_size)", "ceil": "CAST(ceil(p_retailprice) AS BIGINT)", "ceiling": "CAST(ceiling(p_retailprice) AS BIGINT)", "cos": "cos(p_size)", "cosh": "cosh(p_size / 10.0D)",
                "exp": "exp(p_size / 10.0D)", "floor": "CAST(floor(p_retailprice) AS BIGINT)", "ln": "ln(p_size + 1)", "log10": "log10(p_size + 1)", "log2": "log2(p_size + 1)",
                "pow": "pow(p_size, 2)", "power": "power(p_size, 0.5D)", "round": "round(p_retailprice, 1)", "sign": "CAST(sign(p_size - 25) AS DOUBLE)", "sin": "sin(p_size)", "sinh": "sinh(p_size / 10.0D)",
                "sqrt": "sqrt(p_size)", "tan": "tan(p_size)", "tanh": "tanh(p_size)", "degrees": "degrees(p_size)", "radians": "radians(p_size)", "pi": "pi()",
                "least": "least(p_size, 20)", "greatest": "greatest(p_size, 20)", "isnan": "isnan(p_retailprice)",
            }.items()
        }
        | {
            "e": ("e()", "exp(1)"),
            "expm1": ("expm1(p_size / 10.0D)", "exp(p_size / 10.0::DOUBLE) - 1"),
            "log1p": ("log1p(p_size)", "ln(1 + p_size)"),
            "log": ("log(2, p_size + 1)", "log2(p_size + 1)"),
            "hypot": ("hypot(p_size, 3)", "sqrt(p_size * p_size + 9)"),
            "factorial": ("factorial(p_size % 15)", "CAST(factorial(p_size % 15) AS BIGINT)"),
            "bin": ("bin(p_size)", "bin(p_size)"),
            "hex": ("hex(p_size)", "upper(to_hex(p_size))"),
            "conv": ("conv(CAST(p_size AS STRING), 10, 16)", "upper(to_hex(p_size))"),
            "pmod": ("pmod(p_size - 30, 7)", "((p_size - 30) % 7 + 7) % 7"),
            "negative": ("negative(p_size)", "-p_size"),
            "positive": ("positive(p_size)", "p_size"),
            "rint": ("rint(p_retailprice)", "round_even(p_retailprice, 0)"),
            "signum": ("signum(p_size - 25)", "CAST(sign(p_size - 25) AS DOUBLE)"),
            "shiftleft": ("shiftleft(p_size, 2)", "p_size << 2"),
            "shiftright": ("shiftright(p_size, 2)", "p_size >> 2"),
            "shiftrightunsigned": ("shiftrightunsigned(p_size, 1)", "p_size >> 1"),
            "nanvl": ("nanvl(p_retailprice, 0.0D)", "CASE WHEN isnan(p_retailprice) THEN 0 ELSE p_retailprice END"),
            "if": ("if(p_size > 25, 'big', 'small')", "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
            "nvl": ("nvl(nullif(p_size % 3, 0), -1)", "coalesce(nullif(p_size % 3, 0), -1)"),
            "isnull": ("isnull(nullif(p_size % 3, 0))", "nullif(p_size % 3, 0) IS NULL"),
            "isnotnull": ("isnotnull(nullif(p_size % 3, 0))", "nullif(p_size % 3, 0) IS NOT NULL"),
        },
    ),
    "strings": (
        "part",
        "p_partkey",
        {
            name: (sql, sql)
            for name, sql in {
                "ascii": "ascii(p_name)", "concat": "concat(p_brand, '-', p_type)", "concat_ws": "concat_ws('/', p_brand, p_type)", "lcase": "lcase(p_type)", "lower": "lower(p_type)", "length": "CAST(length(p_name) AS BIGINT)",
                "levenshtein": "CAST(levenshtein(p_brand, p_type) AS BIGINT)", "instr": "CAST(instr(p_name, 'e') AS BIGINT)", "lpad": "lpad(p_brand, 12, '*')", "ltrim": "ltrim(concat('  ', p_brand))", "rpad": "rpad(p_brand, 12, '*')",
                "repeat": "repeat(p_brand, 2)", "reverse": "reverse(p_brand)", "rtrim": "rtrim(concat(p_brand, '  '))", "substr": "substr(p_name, 2, 4)", "substring": "substring(p_name, 2, 4)", "translate": "translate(p_brand, 'abd', 'xyz')",
                "trim": "trim(concat(' ', p_brand, ' '))", "ucase": "ucase(p_name)", "upper": "upper(p_name)", "md5": "md5(p_name)", "sha1": "sha1(p_name)",
            }.items()
        }
        | {
            "base64": ("base64(CAST(p_brand AS BINARY))", "to_base64(encode(p_brand))"),
            "unbase64": ("CAST(unbase64(base64(CAST(p_brand AS BINARY))) AS STRING)", "p_brand"),
            "encode": ("decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"),
            "find_in_set": ("find_in_set(CAST(p_size % 3 AS STRING), '0,1,2')", "p_size % 3 + 1"),
            "get_json_object": ("get_json_object(concat('{\"a\": ', p_size, '}'), '$.a')", "CAST(p_size AS VARCHAR)"),
            "initcap": ("initcap('ab cd')", "'Ab Cd'"),
            "locate": ("CAST(locate('e', p_name) AS BIGINT)", "CAST(instr(p_name, 'e') AS BIGINT)"),
            "format_string": ("format_string('%s:%d', p_brand, p_size)", "printf('%s:%d', p_brand, p_size)"),
            "printf": ("printf('%s:%d', p_brand, p_size)", "printf('%s:%d', p_brand, p_size)"),
            "format_number": ("format_number(p_partkey * 1000, 0)", "format('{:,}', p_partkey * 1000)"),
            "regexp_extract": ("regexp_extract(p_brand, '([0-9]+)', 1)", "regexp_extract(p_brand, '([0-9]+)', 1)"),
            "regexp_replace": ("regexp_replace(p_brand, '[0-9]', '#')", "regexp_replace(p_brand, '[0-9]', '#', 'g')"),
            "split": ("concat_ws('|', split(p_name, ' '))", "array_to_string(string_split(p_name, ' '), '|')"),
            "substring_index": ("substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
            "space": ("concat('a', space(3), 'b')", "'a   b'"),
            "soundex": ("soundex('Robert')", "'R163'"),
            "unhex": ("CAST(unhex(hex(p_brand)) AS STRING)", "p_brand"),
            "sha": ("sha(p_name)", "sha1(p_name)"),
            "sha2": ("sha2(p_name, 256)", "sha256(p_name)"),
            "size": ("CAST(size(split(p_name, ' ')) AS BIGINT)", "len(string_split(p_name, ' '))"),
            "sort_array": ("concat_ws('|', sort_array(split(p_name, ' ')))", "array_to_string(list_sort(string_split(p_name, ' ')), '|')"),
            "array_contains": ("array_contains(split(p_name, ' '), 'blue')", "list_contains(string_split(p_name, ' '), 'blue')"),
            "array": ("concat_ws('|', array(p_brand, p_type))", "array_to_string([p_brand, p_type], '|')"),
            "struct": ("struct(p_brand AS a, p_size AS b).a", "p_brand"),
            "named_struct": ("named_struct('a', p_size).a", "p_size"),
            "map_item": ("map('a', p_size, 'b', 0)['a']", "p_size"),
            "coalesce": ("coalesce(NULL, p_brand)", "p_brand"),
        },
    ),
    "dates": (
        "orders",
        "o_orderkey",
        {
            "add_months": ("CAST(add_months(o_orderdate, 2) AS STRING)", "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR)"),
            "datediff": ("CAST(datediff(o_orderdate, DATE'1992-01-01') AS BIGINT)", "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"),
            "date_add": ("CAST(date_add(o_orderdate, 10) AS STRING)", "CAST(CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS VARCHAR)"),
            "date_sub": ("CAST(date_sub(o_orderdate, 10) AS STRING)", "CAST(CAST(CAST(o_orderdate AS DATE) - 10 AS DATE) AS VARCHAR)"),
            "date_format": ("date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
            "from_unixtime": ("from_unixtime(o_orderkey * 3600)", "strftime(make_timestamp(o_orderkey * 3600 * 1000000), '%Y-%m-%d %H:%M:%S')"),
            "last_day": ("CAST(last_day(o_orderdate) AS STRING)", "CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR)"),
            "next_day": ("CAST(next_day(DATE'2024-01-01', 'TU') AS STRING)", "CAST(DATE '2024-01-02' AS VARCHAR)"),
            "to_date": ("CAST(to_date(o_orderdate) AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
            "trunc": ("CAST(trunc(o_orderdate, 'MM') AS STRING)", "CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR)"),
            "unix_timestamp": ("unix_timestamp(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)"),
            "to_unix_timestamp": ("to_unix_timestamp(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)"),
            "from_utc_timestamp": ("date_format(from_utc_timestamp(o_orderdate, 'Asia/Tokyo'), 'yyyy-MM-dd HH')", "strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H')"),
            "to_utc_timestamp": ("date_format(to_utc_timestamp(o_orderdate, 'Asia/Tokyo'), 'yyyy-MM-dd HH')", "strftime(o_orderdate - INTERVAL 9 HOUR, '%Y-%m-%d %H')"),
            "months_between": ("months_between(DATE'2024-03-31', DATE'2024-01-31')", "2.0::DOUBLE"),
        }
        | {name: (f"CAST({name}(o_orderdate) AS BIGINT)", f"CAST({name}(o_orderdate) AS BIGINT)") for name in ("day", "dayofyear", "dayofmonth", "hour", "minute", "month", "quarter", "second", "weekofyear", "year")},
    ),
}
#: Without an equivalent, or not deterministic.
OTHERS = ("orders", "o_orderkey", {"rand": "rand(7)", "randn": "randn(7)", "current_date": "current_date()", "current_timestamp": "current_timestamp()", "now": "now()", "crc32": "crc32(CAST(o_orderstatus AS BINARY))", "partition": "spark_partition_id()", "file": "input_file_name()", "increasing": "monotonically_increasing_id()"})


def runner(table: str, key: str, made: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(key, *(f"{sql} AS `f_{name}`" for name, sql in made.items()))

    return run


QUERIES = {f"functions_{family}": runner(table, key, {n: s for n, (s, _) in made.items()}) for family, (table, key, made) in FAMILIES.items()}
QUERIES["functions_other"] = runner(*OTHERS)
SQL = {f"functions_{family}": f"SELECT {key}, " + ", ".join(f'{(d or s).replace("0D)", "0::DOUBLE)").replace("5D)", "5::DOUBLE)")} AS "f_{n}"' for n, (s, d) in made.items()) + f" FROM {table}" for family, (table, key, made) in FAMILIES.items()}
