"""Mixing sources to target weights by hierarchical budgeting.

A token budget is passed down a domain - language - source tree in proportion to weights.
A child that cannot use its share (its supply is what its leaves hold, times the most
epochs) is filled, and what it leaves goes to its siblings; only what they cannot take
either reaches the siblings of the parent, because the parent's supply already bounds what
was passed to it.  A leaf with budget b and s tokens takes floor(b / s) whole epochs and,
in the next epoch's seeded order, the shortest prefix that holds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, fresh, small_join, stored

#: Hexadecimal digits by which a leaf's order is narrowed at a time, and the rows that are few enough to sort.
DIGITS, FEW = 2, 1_000
#: A table of one small row a leaf is broadcast up to this many rows (about 30 MB).
LEAVES = 200_000

DOMAINS = {"0": 400, "1": 300, "2": 200, "3": 100}
LANGUAGES = {"en": 600, "de": 150, "fr": 150, "es": 100}


def domain_of(source: str = "source") -> Column:
    """The stand-in for a domain table: the first hexadecimal digit of md5(source) modulo 4, as text."""
    digit = F.substring(F.md5(F.coalesce(F.col(source).cast("string"), F.lit("")).cast("binary")), 1, 1)
    return (F.conv(digit, 16, 10).cast("int") % 4).cast("string")


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _weight(weights: dict[str, int], key: Column, other: int) -> Column:
    if not weights:
        return F.lit(other).cast("long")
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(int(v)))))
    return F.coalesce(F.element_at(table, key), F.lit(other)).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """``nodes`` (parent columns, name, supply, parent's budget) with the budget of each node."""
    w, before, rest, level, full = fresh(nodes.columns, "w__", "before__", "rest__", "level__", "full__")
    rank = F.when(F.col(w) > 0, F.col("supply") / F.col(w)).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(rank, name)
    nodes = nodes.withColumn(w, weight)
    nodes = nodes.withColumn(before, F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn(rest, F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn(level, F.when(F.col(rest) > 0, (F.col("budget") - F.col(before)) / F.col(rest)).otherwise(F.lit(0.0)))
    nodes = nodes.withColumn(full, F.col("supply") <= F.col(level) * F.col(w))
    whole = Window.partitionBy(*parent)
    common = F.min_by(F.when(~F.col(full), F.col(level)), F.when(~F.col(full), F.col(before) + F.lit(0))).over(whole)
    share = F.least(F.col("supply"), F.floor(F.coalesce(common, F.lit(0.0)) * F.col(w)).cast("long"))
    return nodes.withColumn("budget", F.when(F.col(full), F.col("supply")).otherwise(share).cast("long")).drop(w, before, rest, level, full)


def leaf_budgets(docs: DataFrame, keys: list[str], tokens: str, budget_share: float, max_epochs: int, weights: list[Column]) -> DataFrame:
    """One row per leaf: its keys, tokens (of one epoch), supply and budget."""
    leaves = stored(docs.groupBy(*keys).agg(F.sum(tokens).cast("long").alias("tokens")).withColumn("supply", F.col("tokens") * max_epochs), "leaves")
    whole = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget_share)).cast("long")).first()[0]
    nodes = None
    for depth, weight in enumerate(weights, 1):
        parents, name = keys[: depth - 1], keys[depth - 1]
        level = leaves.select(*keys, "supply", "tokens")
        if depth < len(keys):
            level = level.groupBy(*keys[:depth]).agg(F.sum("supply").cast("long").alias("supply"), F.sum("tokens").cast("long").alias("tokens"))
        level = level.join(nodes.select(*parents, "budget"), parents) if parents else level.withColumn("budget", F.lit(whole).cast("long"))
        nodes = _fill(level, parents, name, weight)
    nodes = stored(nodes, "budgets")
    discard(leaves)
    return nodes


def _ends(ordered: DataFrame, keys: list[str], n: str, order: str, tie: str, rest: str) -> DataFrame:
    """For each leaf where the prefix of its order that holds ``rest`` tokens ends: the last (order, tie) in it,
    how many rows have both (of_), and how many of these it takes (take_).

    The order's digits narrow the place down, a few at a time, by sums over all rows that are
    left, until few rows of any leaf are; only these are sorted.  Equal rows count as one.
    """
    left = ordered.groupBy(*keys, order, tie, rest).agg(F.max(n).alias(n), F.count("*").alias("of_"))
    left = stored(left.withColumn("before_", F.lit(0).cast("long")), "order")
    running, digits, made = Window.partitionBy(*keys).orderBy("digits_"), 0, [left]
    most = left.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    while most > FEW and digits < 32:
        cut = left.withColumn("digits_", F.substring(order, digits + 1, DIGITS))
        sums = cut.groupBy(*keys, "digits_").agg(F.sum(F.col(n) * F.col("of_")).alias("tokens_"), F.max(rest).alias("rest_"), F.max("before_").alias("from_"), F.count("*").alias("rows_"))
        sums = sums.withColumn("upto_", F.col("from_") + F.sum("tokens_").over(running.rowsBetween(Window.unboundedPreceding, 0))).filter("upto_ >= rest_")
        first = sums.groupBy(*keys).agg(F.min(F.struct("digits_", (F.col("upto_") - F.col("tokens_")).alias("from_"), "rows_")).alias("first_"))
        first = stored(first.select(*keys, "first_.*"), "digits")
        n_leaves, most = first.agg(F.count("*"), F.coalesce(F.max("rows_"), F.lit(0))).first()
        cut = small_join(cut, first.drop("rows_"), [*keys, "digits_"], rows=n_leaves if n_leaves > LEAVES else 0)
        left = stored(cut.withColumn("before_", F.col("from_").cast("long")).drop("digits_", "from_"), "order")
        made += [left, first]
        digits += DIGITS
    prefix = Window.partitionBy(*keys).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    at = left.withColumn("before_", F.col("before_") + F.coalesce(F.sum(F.col(n) * F.col("of_")).over(prefix), F.lit(0))).filter(F.col("before_") < F.col(rest))
    take = F.when(F.col(n) > 0, F.least("of_", F.ceil((F.col(rest) - F.col("before_")) / F.col(n)))).otherwise(F.col("of_")).cast("long")
    ends = stored(at.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("order_"), F.col(tie).alias("tie_"), take.alias("take_"), "of_")).alias("end")).select(*keys, "end.*"), "ends")
    discard(*made)
    return ends


def mix(
    docs: DataFrame,
    tokens: Column | None = None,
    budget_share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 7,
    domain: Column | None = None,
    domain_weights: dict[str, int] | None = None,
    language_weights: dict[str, int] | None = None,
    source_weights: dict[str, int] | None = None,
    doc_id: str = "doc_id",
    names: tuple[str, str] = ("n_tokens", "epoch"),
) -> DataFrame:
    """The chosen rows of ``docs``, once for each epoch that takes them, with n_tokens and epoch (from 0), under ``names``.

    The budget is ``budget_share`` of all tokens (words, unless ``tokens`` says otherwise).
    Weights are whole numbers by value; a value that a table does not name weighs 100, and
    with the tables empty all weigh alike.  The order of a leaf in an epoch is that of
    md5("seed:epoch:doc_id"), ties by a hash of the text; a document is taken if the tokens
    before it are fewer than what the leaf still needs.  Null domains, languages and sources
    are leaves of their own; a null doc_id counts as the empty text in the order; a null or
    empty text has no tokens, and is taken only where the prefix reaches over it or with whole
    epochs.  Rows equal in doc_id and text are taken one by one.  A weight of 0 takes nothing.
    Texts of any length count whole.  An empty table gives an empty table.  ``docs`` needs
    columns text, lang and source; columns of it that have one of ``names`` give way.

    Texts are read twice and never shuffled up to :data:`LEAVES` leaves; beyond, they are
    joined with their decisions by leaf, doc_id and hash, which no large leaf can crowd.
    """
    domain_weights = DOMAINS if domain_weights is None else domain_weights
    language_weights = LANGUAGES if language_weights is None else language_weights
    kept = [c for c in docs.columns if c.lower() not in names]
    dk, lk, sk, n, order, ident, tie, epochs, rest = fresh(
        [*docs.columns, "tokens", "supply", "budget", "order_", "tie_", "take_", "of_"], *(f"{x}__" for x in ("domain", "lang", "source", "n", "order", "ident", "tie", "epochs", "rest"))
    )
    keys = [dk, lk, sk]
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?"))
    all_rows = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        named(domain_of() if domain is None else domain).alias(dk),
        named(F.col("lang")).alias(lk),
        named(F.col("source")).alias(sk),
        (n_words() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias(n),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(ident),
        F.xxhash64(F.col("text").cast("string")).alias(tie),
    )
    in_epoch = F.md5(F.concat(F.lit(f"{seed}:"), F.col(epochs).cast("string"), F.lit(":"), F.col(ident)).cast("binary"))
    thin = stored(all_rows.select(*keys, n, ident, tie), "counted")
    weights = [_weight(domain_weights, F.col(dk), 100), _weight(language_weights, F.col(lk), 100), _weight(source_weights or {}, F.col(sk), 100)]
    budgets = leaf_budgets(thin, keys, n, budget_share, max_epochs, weights)
    leaves = budgets.filter("tokens > 0 and budget > 0").select(*keys, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias(epochs), (F.col("budget") % F.col("tokens")).cast("long").alias(rest))
    n_leaves = leaves.count()
    ordered = small_join(thin, leaves.filter(F.col(rest) > 0), keys, rows=n_leaves if n_leaves > LEAVES else 0).withColumn(order, in_epoch)
    ends = _ends(ordered, keys, n, order, tie, rest)
    plan = stored(leaves.join(ends, keys, "left").drop(rest), "plan")

    if n_leaves <= LEAVES:
        chosen = all_rows.join(F.broadcast(plan), keys)
    else:
        chosen = all_rows.join(thin.select(*keys, ident, tie).distinct().join(plan, keys), [*keys, ident, tie])
    # Rows up to the end of the leaf's prefix get one epoch more than the whole ones.
    place, end = F.struct(order, tie), F.struct(F.col("order_").alias(order), F.col("tie_").alias(tie))
    chosen = chosen.withColumn(order, in_epoch)
    inside = F.coalesce((place < end) | ((place == end) & (F.col("take_") == F.col("of_"))), F.lit(False))
    columns = [F.col(f"`{c}`") for c in kept]
    if not plan.filter("take_ < of_").isEmpty():  # some of several equal rows
        same = Window.partitionBy(*keys).orderBy(F.xxhash64(*columns))
        split = F.coalesce((place == end) & (F.col("take_") < F.col("of_")), F.lit(False))
        some = chosen.filter(split).withColumn(order, F.row_number().over(same) <= F.col("take_"))
        chosen = chosen.filter(~split).withColumn(order, inside).unionByName(some)
        inside = F.col(order)
    chosen = chosen.withColumn(epochs, F.col(epochs) + inside.cast("long")).filter(F.col(epochs) > 0)
    discard(budgets, ends, *([thin] if n_leaves <= LEAVES else []))
    return chosen.select(*columns, F.col(n).alias(names[0]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(epochs) - 1)).alias(names[1]))


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The rows that :func:`mix` chooses, with their own columns, once for each epoch; its docstring says what odd rows do."""
    names = fresh(docs.columns, "n_tokens", "epoch")
    return mix(docs, names=tuple(names), **parameters).drop(*names)


def _fill_sql(name: str, nodes: str, parents: str, key: str, weight: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    up = f"{parents}, " if parents else ""
    return f"""
{name}_a AS (SELECT *, CASE WHEN w > 0 THEN supply / w ELSE 'infinity'::DOUBLE END AS ratio FROM (SELECT *, {weight} AS w FROM {nodes})),
{name}_b AS (
  SELECT *, coalesce(sum(supply) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(w) OVER ({by} ORDER BY ratio, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_w
  FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN rest_w > 0 THEN (budget - before) / rest_w ELSE 0.0::DOUBLE END AS level FROM {name}_b),
{name}_d AS (SELECT *, supply <= level * w AS is_full FROM {name}_c),
{name}_e AS (SELECT {up}arg_min(level, before) AS common FROM {name}_d WHERE NOT is_full {f'GROUP BY {parents}' if parents else ''}),
{name} AS (
  SELECT {up}{key}, tokens, CASE WHEN is_full THEN supply ELSE least(supply, floor(coalesce(common, 0.0) * w)::BIGINT) END::BIGINT AS budget
  FROM {name}_d {f'LEFT JOIN {name}_e USING ({parents})' if parents else f'CROSS JOIN {name}_e'})"""


def mix_sql(budget_share: float = 0.5, max_epochs: int = 4, seed: int = 7) -> str:
    """DuckDB's SQL for the rows of :func:`mix` with the default weights: doc_id, domain, lang, source, n_tokens, epoch."""
    case = lambda column, weights: "CASE " + column + "".join(f" WHEN '={k}' THEN {v}" for k, v in weights.items()) + " ELSE 100 END"
    level = lambda keys: f"SELECT {keys}, sum(tokens)::BIGINT AS tokens, sum(supply)::BIGINT AS supply FROM leaf GROUP BY {keys}"
    return rf"""
WITH base AS MATERIALIZED (
  SELECT doc_id, lang, source, (('0x' || left(md5(coalesce(source, '')), 1))::INT % 4)::VARCHAR AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, coalesce(doc_id::VARCHAR, '') AS ident
  FROM documents),
keyed AS MATERIALIZED (SELECT *, '=' || domain AS dk, coalesce('=' || lang, '?') AS lk, coalesce('=' || source, '?') AS sk FROM base),
leaf AS MATERIALIZED (SELECT dk, lk, sk, sum(n)::BIGINT AS tokens, (sum(n) * {max_epochs})::BIGINT AS supply FROM keyed GROUP BY ALL),
total AS (SELECT floor(coalesce(sum(tokens), 0)::BIGINT * {budget_share}::DOUBLE)::BIGINT AS budget FROM leaf),
n1 AS (SELECT * FROM ({level('dk')}) CROSS JOIN total),{_fill_sql('f1', 'n1', '', 'dk', case('dk', DOMAINS))},
n2 AS (SELECT * FROM ({level('dk, lk')}) JOIN (SELECT dk, budget FROM f1) USING (dk)),{_fill_sql('f2', 'n2', 'dk', 'lk', case('lk', LANGUAGES))},
n3 AS (SELECT * FROM leaf JOIN (SELECT dk, lk, budget FROM f2) USING (dk, lk)),{_fill_sql('f3', 'n3', 'dk, lk', 'sk', '100')},
plan AS MATERIALIZED (SELECT dk, lk, sk, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM f3),
ranked AS (
  SELECT k.*, p.epochs, p.rest,
         coalesce(sum(n) OVER (PARTITION BY dk, lk, sk ORDER BY md5('{seed}:' || p.epochs || ':' || ident), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN plan p USING (dk, lk, sk)),
taken AS (SELECT doc_id, domain, lang, source, n AS n_tokens, epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(copies))::BIGINT AS epoch FROM taken WHERE copies > 0"""
