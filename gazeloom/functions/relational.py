"""Relational plans as SQL text that Spark runs and DuckDB checks.

A plan is a chain of named relations. Where the dialects differ the text holds a
``@name(...)`` macro. Spark gets the input DataFrames and the earlier relations bound by
name, so nothing stays registered in the session, each relation is analysed once, by
itself, and Catalyst optimises the whole chain.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

#: Macro -> (Spark, DuckDB); {0} and so on are its arguments.
MACROS = {
    "json_k": ("get_json_object({0}, '$.k')", "json_extract_string({0}, '$.k')"),
    "micros": ("unix_micros(CAST({0} AS TIMESTAMP))", "epoch_us({0})"),
    "upto": ("explode(sequence(1, CAST({0} AS INT)))", "unnest(generate_series(1, CAST({0} AS INT)))"),
    "except": ("* EXCEPT ({0})", "* EXCLUDE ({0})"),
    "half_even": ("bround({0})", "round_even({0}, 0)"),
    "letter": ("char(CAST(65 + {0} AS INT))", "chr(CAST(65 + {0} AS INT))"),
}
_MACRO = re.compile(r"@(\w+)\(")
_SOURCE = re.compile(r"\b(FROM|JOIN) (\w+)\b")


def r6(x: str) -> str:
    """Six decimals, alike in both engines: exact ties are nudged up, so noise in the last bits does not show."""
    return f"floor(({x}) * 1e6 + 0.5001) / 1e6"


def bcea_sql(probability: float) -> str:
    """Bivariate contour ellipse area of columns x, y in a group; 0 where all points lie on a line."""
    det = "var_samp(x) * var_samp(y) - power(covar_samp(x, y), 2)"
    return f"{2 * math.pi * -math.log(1 - probability)} * CASE WHEN {det} <= 1e-9 * var_samp(x) * var_samp(y) THEN 0.0 ELSE sqrt({det}) END"


class Plan:
    """Named relations, the last of which is the result."""

    def __init__(self, steps: dict[str, str] | None = None):
        self.steps = dict(steps or {})

    def then(self, name: str, text: str) -> Plan:
        return Plan(self.steps | {name: " ".join(text.split())})

    def merge(self, other: Plan) -> Plan:
        return Plan(self.steps | other.steps)

    def text(self, dialect: int) -> str:
        *inner, (last, final) = self.steps.items()
        out = ("WITH " + ",\n".join(f"{n} AS ({t})" for n, t in inner) + "\n" if inner else "") + final
        while m := _MACRO.search(out):
            end, depth = m.end(), 1
            while depth:
                depth += {"(": 1, ")": -1}.get(out[end], 0)
                end += 1
            out = out[: m.start()] + MACROS[m[1]][dialect].format(out[m.end() : end - 1]) + out[end:]
        return out

    def spark(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """Run over DataFrames bound to the ``{name}`` places of the text.

        One long text would reach the analyzer's limit of iterations.
        """
        made: dict[str, DataFrame] = {}
        for name, step in self.steps.items():
            text = Plan({name: step}).text(0)
            earlier = {m[2] for m in _SOURCE.finditer(text) if m[2] in made}
            text = _SOURCE.sub(lambda m, earlier=earlier: f"{m[1]} {{{m[2]}}}" if m[2] in earlier else m[0], text)
            given = {k: v for k, v in inputs.items() if f"{{{k}}}" in text}
            made[name] = spark.sql(text, **(given | {k: made[k] for k in earlier}))
        return made[name]

    def duckdb(self) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", self.text(1))
