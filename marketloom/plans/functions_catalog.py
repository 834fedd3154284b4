"""Named functions over the market tables, batch scoring and plan execution."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as X

c = F.col


def describe(spark: SparkSession) -> DataFrame:
    """Catalog of named functions with their descriptions."""
    from .registry import ABOUT

    return spark.createDataFrame(sorted(ABOUT.items()), "name string, description string")


def install(spark: SparkSession) -> None:
    """SQL scalar functions for the text and name rules, as plain SQL expressions that
    Catalyst inlines (no Python at run time)."""
    for name, args, body in [
        ("normalize_name", "t STRING", "trim(regexp_replace(regexp_replace(lower(coalesce(t,'')), '[^a-z0-9\\\\s]', ' '), '\\\\s+', ' '))"),
        ("feed_symbol", "t STRING", "CASE WHEN t LIKE '^%' OR t LIKE '%=X' OR t LIKE '%.NS' OR t LIKE '%.BO' THEN t ELSE concat(t, '.NS') END"),
        ("pct_change_of", "p DOUBLE, q DOUBLE", "CASE WHEN q > 0 THEN floor((p - q) / q * 100 * 100 + 0.5) / 100 END"),
    ]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {'DOUBLE' if name.startswith('pct') else 'STRING'} RETURN {body}")


@dataclass(frozen=True)
class TableFunction:
    """A named SQL table function: arguments (name, type), result columns and its body over views."""
    name: str
    about: str
    arguments: tuple[tuple[str, str], ...]
    returns: str
    views: tuple[str, ...]
    body: str


_LINKS = ("(SELECT from_id AS id, to_id AS other, relation_type, 'out' AS direction FROM edges_view "
          "UNION ALL SELECT to_id, from_id, relation_type, 'in' FROM edges_view)")

#: Every body is one SELECT whose arguments meet columns by equality, so a call over a table of arguments
#: (LATERAL) becomes a join; only the searches compare texts or vectors row by row.
TABLE_FUNCTIONS = [
    TableFunction("company_info", "Node of a ticker: name, type and domain.", (("ticker", "STRING"),),
                  "id STRING, canonical_name STRING, entity_type STRING, domain STRING", ("nodes",),
                  "SELECT id, canonical_name, entity_type, domain FROM nodes_view WHERE id = lower(company_info.ticker)"),
    TableFunction("technical_signals", "Newest signal of a ticker: action, regime, score, confidence, levels.", (("ticker", "STRING"),),
                  "suggested_action STRING, regime STRING, score DOUBLE, confidence DOUBLE, support DOUBLE, resistance DOUBLE", ("signals",),
                  "SELECT s.suggested_action, s.regime, s.score, s.confidence, s.support, s.resistance FROM signals_view s WHERE s.ticker = technical_signals.ticker"),
    TableFunction("news_sentiment", "Weighted news sentiment of a ticker and its articles.", (("ticker", "STRING"),),
                  "score DOUBLE, articles_found BIGINT", ("sentiment",),
                  "SELECT s.score, s.articles_found FROM sentiment_view s WHERE s.ticker = news_sentiment.ticker"),
    TableFunction("radar_alerts", "Current alerts of a ticker.", (("ticker", "STRING"),),
                  "title STRING, body STRING, strength DOUBLE", ("alerts",),
                  "SELECT a.title, a.body, a.strength FROM alerts_view a WHERE a.ticker = radar_alerts.ticker"),
    TableFunction("search_nodes", "First k nodes by id whose name holds a text.", (("wanted", "STRING"), ("k", "INT")),
                  "id STRING, canonical_name STRING", ("nodes",),
                  "SELECT id, canonical_name FROM (SELECT id, canonical_name, row_number() OVER (ORDER BY id) AS place FROM nodes_view "
                  "WHERE contains(lower(canonical_name), lower(search_nodes.wanted))) WHERE place <= search_nodes.k"),
    TableFunction("explore_connections", "Neighbours of a node with relation, direction and name.", (("node", "STRING"),),
                  "relation_type STRING, direction STRING, id STRING, canonical_name STRING", ("nodes", "edges"),
                  f"SELECT l.relation_type, l.direction, n.id, n.canonical_name FROM {_LINKS} l JOIN nodes_view n ON n.id = l.other WHERE l.id = explore_connections.node"),
    TableFunction("graph_overview", "Nodes of the graph by type.", (), "entity_type STRING, total BIGINT", ("nodes",),
                  "SELECT entity_type, count(*) FROM nodes_view GROUP BY entity_type"),
    TableFunction("macro_latest", "Last value of a series, the one before and the change in percent.", (("series", "STRING"),),
                  "price DOUBLE, prev DOUBLE, pct_change DOUBLE", ("macro",),
                  "SELECT m.last, m.prev, CASE WHEN m.prev > 0 THEN (m.last - m.prev) / m.prev * 100 END FROM macro_view m WHERE m.symbol = macro_latest.series"),
    TableFunction("holding", "Quantity and average cost of a symbol in the portfolio.", (("wanted", "STRING"),),
                  "quantity DOUBLE, avg_cost DOUBLE", ("holdings",),
                  "SELECT h.quantity, h.avg_cost FROM holdings_view h WHERE h.symbol = holding.wanted"),
]


def functions(spark: SparkSession) -> DataFrame:
    """The registry as a table: name, arguments with types, result columns, description."""
    rows = [(f.name, [a for a, _ in f.arguments], [t for _, t in f.arguments], f.returns, f.about) for f in TABLE_FUNCTIONS]
    return spark.createDataFrame(rows, "name string, arguments array<string>, argument_types array<string>, returns string, description string")


def install_tables(spark: SparkSession, views: dict[str, Callable[[], DataFrame]], names: list[str] | None = None) -> list[str]:
    """Create the named table functions (all that the given views allow by default) for this session.

    Views are made only for functions that are created; an unknown name, or one whose view is
    missing, raises KeyError. A later call replaces views and functions of the same name."""
    known = {f.name: f for f in TABLE_FUNCTIONS}
    wanted = [known[n] for n in names] if names is not None else [f for f in TABLE_FUNCTIONS if set(f.views) <= set(views)]
    for view in sorted({v for f in wanted for v in f.views}):
        views[view]().createOrReplaceTempView(f"{view}_view")
    for f in wanted:
        arguments = ", ".join(f"{a} {t}" for a, t in f.arguments)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f.name}({arguments}) RETURNS TABLE({f.returns}) RETURN {f.body}")
    return [f.name for f in wanted]


def batch_score(items: DataFrame, scorer, id_col: str, text_col: str) -> DataFrame:
    """Scores of an injected batch scorer: pandas frame of (id, text) in, series out."""
    def run(batches):
        for pdf in batches:
            yield pdf[[id_col]].assign(score=scorer(pdf[text_col]).astype(float))

    return items.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(items.dtypes)[id_col]}, score double")


def gather(plan: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """Run a plan table of (ticker, function) rows against result tables (F04): each result has
    (ticker, value text); values come back per ticker without a driver loop."""
    parts = None
    for name, df in results.items():
        rows = df.select("ticker", F.lit(name).alias("function"), "value")
        parts = rows if parts is None else parts.unionByName(rows)
    d = plan.join(parts, ["ticker", "function"], "left").select("ticker", "function", F.coalesce("value", F.lit("no result")).alias("value"))
    return d.groupBy("ticker").agg(F.array_sort(F.collect_set(F.concat("function", F.lit("="), "value"))).alias("results"))
