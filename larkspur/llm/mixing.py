"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to). The driver routes each
pattern's token capacity to the quotas of its sources: the first pass over a pattern costs least, each repetition more
(convex costs, `max_repeat` passes at most). What a pattern must give beyond its whole passes is taken from its documents
in a seeded order, the document at the border giving only the words that are missing.

Edge cases: null or empty texts have size 0 and give 0 words; a null source is a source of its own, sorted last; an empty
table gives an empty result; repeated rows count each; ties of the seeded order are broken by id, then size (rows equal
in all three are interchangeable). Other columns of the input pass through; columns named like a result are replaced.
The number of patterns is checked against `max_patterns` before anything is collected.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize, shared_dir

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "larkspur-mix:"
MAX_PATTERNS = 100_000
DIGITS = 3  # of the draw, in a coarse bucket; twice as many in a fine one
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(total: float, weights: dict, caps: dict) -> dict:
    """Shares total by weight; none gets more than its cap, the excess goes to the others by weight."""
    order = sorted(weights, key=lambda k: caps[k] / weights[k])
    full, rest = 0.0, sum(weights.values())
    out = {}
    for k in order:
        level = (total - full) / rest
        if level * weights[k] > caps[k]:
            out[k] = float(caps[k])
            full += caps[k]
            rest -= weights[k]
        else:
            return out | {x: level * weights[x] for x in order if x not in out}
    return out


def route(capacity: dict, quotas: dict, max_repeat: int = MAX_REPEAT) -> dict:
    """Min-cost flow from patterns (tuples of sources) to sources: {(pattern, source): tokens}.

    Costs sit on the passes over a pattern alone and rise with each, so the sets of passes that can be routed form a
    polymatroid, and filling pass after pass with augmenting paths is optimal.
    """
    flow: dict = defaultdict(int)
    left = dict(quotas)
    used: dict = defaultdict(int)
    by_source = defaultdict(list)
    for p in capacity:
        for s in p:
            by_source[s].append(p)
    for level in range(1, max_repeat + 1):
        for root in capacity:
            while (room := level * capacity[root] - used[root]) > 0:
                came, queue, end = {root: None}, deque([root]), ()
                while queue and not end:
                    p = queue.popleft()
                    for s in p:
                        if (0, s) in came:
                            continue
                        came[0, s] = p
                        if left.get(s, 0) > 0:
                            end = (0, s)  # no pattern has a number in it
                            break
                        for q in by_source[s]:
                            if q not in came and flow[q, s] > 0:
                                came[q] = (0, s)
                                queue.append(q)
                if not end:
                    break
                path, node = [], end
                while node is not None:
                    path.append(node)
                    node = came[node]
                steps = list(zip(path[1::2], path[::2], strict=True))  # (pattern, source it gains)
                back = [(path[i], path[i + 1][1]) for i in range(1, len(path) - 1, 2)]  # (pattern, source it loses)
                amount = min([room, left[end[1]], *(flow[q, s] for q, s in back)])
                for p, s in steps:
                    flow[p, s[1]] += amount
                for q, s in back:
                    flow[q, s] -= amount
                left[end[1]] -= amount
                used[root] += amount
    return {k: v for k, v in flow.items() if v}


def plan(sizes: list[tuple[tuple, int]], weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[dict, dict, dict]:
    """From (pattern, size) rows: source sizes, targets, and tokens to take from each pattern."""
    size: dict = defaultdict(int)
    for pattern, n in sizes:
        for s in pattern:
            size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(n for _, n in sizes)
    target = water_fill(float(total), share, {s: max_repeat * size[s] for s in names}) if names else {}
    quotas = {s: int(target[s] + 0.5) for s in names}
    taken: dict = defaultdict(int)
    for (p, _), n in route(dict(sizes), quotas, max_repeat).items():
        taken[p] += n
    return dict(size), target, {p: taken[p] for p, _ in sizes}


def mix_sources(docs: DataFrame, sized: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text", size_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    source_col is a string, or an array of strings where documents belong to several sources (the smallest of them
    then gives source_size and target). size_col names a ready size; else the words of text_col are counted.
    """
    many = docs.schema[source_col].dataType.typeName() == "array"
    results = ("size", "source_size", "target", "taken")
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no name clashes
    rows = docs.toDF(*own.values())
    size = F.coalesce(F.col(own[size_col]), F.lit(0)).cast("long") if size_col else word_count(F.col(own[text_col]))
    source, number = F.col(own[source_col]), F.col(own[id_col])
    members = F.array_sort(F.array_distinct(source)) if many else F.array(source)
    # a string that tells patterns apart, null sources included
    key = F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"key": key, "draw": F.md5(F.concat(F.lit(seed), F.coalesce(number.cast("string"), F.lit(""))))})
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    coarse, fine = F.substring("draw", 1, DIGITS), F.substring("draw", 1, 2 * DIGITS)
    buckets = rows.groupBy("key", coarse.alias("bucket")).agg(F.sum(size).alias("n"), F.first(members).alias("m"))
    buckets = materialize(buckets, folder, "buckets")
    patterns = buckets.groupBy("key").agg(F.first("m").alias("m"), F.sum("n").alias("n"))
    found = patterns.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    sizes, target, taken = plan([(tuple(r.m or ()), r.n) for r in found], weights, max_repeat)
    table = []
    for r in found:
        p = tuple(r.m or ())
        passes, rest = divmod(taken[p], r.n) if r.n else (0, 0)
        first = p[0] if p else None
        table.append((r.key, sizes.get(first, 0), float(target.get(first, 0.0)), passes, rest))
    quota = spark.createDataFrame(table, "key string, source_size long, target double, passes long, rest long")

    def border(sums: DataFrame, wanted: DataFrame) -> DataFrame:
        """The bucket of the seeded order in which a pattern's remainder ends, and what is missing there; 16**DIGITS rows a
        pattern at most."""
        before = sums.join(wanted, "key").withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")) - F.col("n"))
        return before.where("before < rest AND before + n >= rest").select("key", F.col("bucket").alias("last"), (F.col("rest") - F.col("before")).alias("rest"))

    outer = materialize(border(buckets.select("key", "bucket", "n"), quota.select("key", "rest")), folder, "border")
    inside = rows.join(outer, "key").where(coarse == F.col("last")).groupBy("key", fine.alias("bucket")).agg(F.sum(size).alias("n"))
    inner = border(inside, outer.select("key", "rest"))
    quota = quota.drop("rest").join(inner, "key", "left").select("key", "source_size", "target", "passes", F.coalesce("last", F.lit("")).alias("last"), F.coalesce("rest", F.lit(0)).alias("rest"))
    quota = materialize(quota, folder, "quota")
    rows = rows.withColumns({"size": size, "bucket": fine}).join(quota, "key")
    whole = rows.where("bucket != last").withColumn("extra", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("key").orderBy("draw", number, "size").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.where("bucket = last").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    out = whole.unionByName(part).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    return out.select(*(F.col(c).alias(name) for name, c in own.items() if name not in results), *results)


def mix_documents(documents: DataFrame) -> DataFrame:
    """The op3 digest: words are counted once and kept in the shared folder; the mix runs over these counts."""
    counts = materialize(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), shared_dir(documents.sparkSession), "sizes")
    return mix_sources(counts, text_col=None, size_col="size").select("doc_id", "size", "source_size", "target", "taken")


_HEAD = """
sized AS (SELECT doc_id, source, {size} AS size FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM per),
ranked AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM named),
lines AS (SELECT *, (SELECT sum(source_size) FROM per)::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ranked),
stop AS (SELECT min(k) AS k FROM lines WHERE (total - full_) / rest * w <= cap),
level AS (SELECT (total - full_) / rest AS v FROM lines WHERE k = (SELECT k FROM stop)),
quota AS (SELECT source, source_size, CASE WHEN k < coalesce((SELECT k FROM stop), 1000000000) THEN cap ELSE (SELECT v FROM level) * w END AS target FROM ranked),
cut AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % source_size END AS rest FROM quota),
drawn AS (SELECT s.doc_id, s.size, c.source_size, c.target, c.passes, c.rest, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('larkspur-mix:' || CAST(s.doc_id AS VARCHAR)), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
"""
SQL_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
ORACLE_SQL = "WITH " + _HEAD.format(size=f"CAST({SQL_WORDS} AS BIGINT)", docs="documents").strip() + """
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM drawn
"""
