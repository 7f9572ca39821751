"""The queries on training data, by name, with SQL counterparts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import capping, mixing, neardup, neighbours, packing, splitting, sql, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": capping.p1_found,
        "p1_nested": capping.p1_nested,
        "p1_dominance": capping.p1_dominance,
        "p2_found": neardup.p2_found,
        "p2_groups": neardup.p2_groups,
        "p4_found": neighbours.p4_found,
        "p4_neighbours": neighbours.p4_neighbours,
        "p5_found": splitting.p5_found,
        "p5_pieces": splitting.p5_pieces,
        "p5_report": splitting.p5_report,
        "p5_sizes": splitting.p5_sizes,
        "p6_assign": packing.p6_assign,
        "p6_fill": packing.p6_fill,
        "p7_mix": mixing.p7_mix,
        "p7_held": mixing.p7_held,
        "p7_shares": mixing.p7_shares,
        "p8_found": toxicity.p8_found,
        "p8_scores": toxicity.p8_scores,
        "p8_rates": toxicity.p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
