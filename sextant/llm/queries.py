"""The queries of the training-data operators, by problem, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import docpairs, languages, leakage, mixing, neardup, neighbours, splitting, syntax
from sextant.sources.tables import current_rows, table

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, d: str, *columns: str, only: str | None = None) -> DataFrame:
    chunks = table(spark, d, "chunks")
    wide = chunks if only is None else chunks.filter(only)
    return current_rows(chunks, wide.select("seq", *columns))


# -- 1
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_methods(table(spark, d, "graph_events")).select("id")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documented methods with the code of their newest METHOD chunk, else of their newest source file, null where neither has it."""
    methods = docpairs.documented_methods(table(spark, d, "graph_events"))
    code = _chunks(spark, d, "fqn", "text", only="type = 'METHOD' and fqn is not null and text is not null")
    newest = code.groupBy("fqn").agg(F.max_by("text", "seq").alias("code"))
    files = table(spark, d, "source_files")
    parsed = docpairs.method_code(files.withColumn("lang", syntax.language(F.col("path"), F.col("lang")))).withColumnRenamed("code", "parsed")
    found = methods.join(newest, methods["id"] == newest["fqn"], "left").join(parsed, F.regexp_replace("id", r"\s+", "") == F.col("key"), "left")
    return found.select("id", "signature", "doc", F.coalesce("code", "parsed").alias("code"))


def p1_islands(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return docpairs.island_pairs(files.withColumn("lang", syntax.language(F.col("path"), F.col("lang"))))


# -- 2
def _neighbours(spark: SparkSession, d: str, floor: float | None, rerank: int = neighbours.RERANK) -> DataFrame:
    return neighbours.most_similar(_chunks(spark, d, "vector"), k=5, dim=64, floor=floor, rerank=rerank)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_neighbours(spark, d, 0.88)).select("seq_a", "seq_b")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, None, rerank=8)  # fewer, as no floor drops any on their way; they only bound the completing search


# -- 3
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_faults(table(spark, d, "source_files")).filter("not valid").select("file_id")


def p3_faults(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_faults(table(spark, d, "source_files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.fault_rates(table(spark, d, "source_files"))


# -- 4
def _near(spark: SparkSession, d: str, width: int, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    return neardup.near_classes(_chunks(spark, d, "text", only="domain = 'KNOWLEDGE'"), width, threshold, least)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(*_near(spark, d, 3, 0.6, 10))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.linked_members(*_near(spark, d, 5, 0.8, 1))


# -- 5
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_nodes(_chunks(spark, d, "text", only=f"length(text) > {splitting.LIMIT}"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_chunks(spark, d, "section", "text", only=f"length(text) > {splitting.LIMIT}"))


# -- 6
def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("verbatim").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


# -- 7
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


# -- 8
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.unnamed_languages(table(spark, d, "documents")).select("doc_id", "lang")


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "documents"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.main_languages(languages.segments(table(spark, d, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p1_islands, p2_found, p2_neighbours, p3_found, p3_faults, p3_rates, p4_found, p4_groups, p5_found, p5_pieces, p6_found, p6_leaks, p7_mix, p7_shares, p8_found, p8_segments, p8_documents)
}

_CURRENT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch, id ORDER BY seq DESC) AS rn FROM chunks) WHERE rn = 1"""

# p4_found by plain set comparison; the prefix of three shared words only lists which pairs to compare.
_P4_FOUND = f"""
WITH k AS (SELECT seq, text FROM ({_CURRENT}) WHERE domain = 'KNOWLEDGE' AND text IS NOT NULL),
w AS (SELECT seq, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM k),
s AS (SELECT DISTINCT seq, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT seq, count(*) AS n FROM s GROUP BY seq HAVING count(*) >= 10),
x AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.seq < b.seq GROUP BY 1, 2)
SELECT seq_a, seq_b FROM x JOIN n na ON na.seq = seq_a JOIN n nb ON nb.seq = seq_b WHERE n_both >= 0.6 * (na.n + nb.n - n_both)
"""

# Classes of equal sets of five-word sequences (a shorter text is one sequence), and their links at 0.8.
_P4_GROUPS = f"""
WITH k AS (SELECT seq, text FROM ({_CURRENT}) WHERE domain = 'KNOWLEDGE' AND text IS NOT NULL),
w AS (SELECT seq, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM k),
s AS (SELECT DISTINCT seq, unnest(CASE WHEN len(w) >= 5 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) >= 1),
l AS (SELECT seq, list(g ORDER BY g) AS all_of, count(*) AS n FROM s GROUP BY seq),
c AS (SELECT seq, n, min(seq) OVER (PARTITION BY all_of) AS class_id, count(*) OVER (PARTITION BY all_of) AS copies FROM l),
r AS (SELECT s.seq, s.g, c.n FROM s JOIN c ON c.seq = s.seq AND c.class_id = s.seq),
x AS (SELECT a.seq AS a, b.seq AS b FROM r a JOIN r b ON a.g = b.g AND a.seq <> b.seq GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
d AS (SELECT a, count(*) AS links FROM x GROUP BY a)
SELECT seq, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN d ON d.a = class_id
"""

# Lines, running fences and separating blank lines.
_P5_FOUND = f"""
WITH t AS (SELECT seq, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS b FROM ({_CURRENT}) WHERE text IS NOT NULL),
big AS (SELECT * FROM t WHERE length(b) > 4000),
l AS (SELECT seq, u.line, u.n FROM big, LATERAL (SELECT unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS n) u),
f AS (SELECT *, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY n) AS fences FROM l),
p AS (SELECT *, regexp_full_match(line, '\\s*') AND fences % 2 = 0 AND NOT line LIKE '```%' AS parts FROM f),
g AS (SELECT *, sum(parts::INT) OVER (PARTITION BY seq ORDER BY n) AS grp FROM p),
k AS (SELECT seq, grp, string_agg(line, chr(10) ORDER BY n) AS block FROM g WHERE NOT parts GROUP BY seq, grp),
o AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY grp) AS block_no, regexp_replace(regexp_replace(block, '^\\s+', ''), '\\s+$', '') AS block FROM k)
SELECT seq, 0::BIGINT AS block_no FROM big UNION ALL SELECT seq, block_no FROM o WHERE length(block) > 4000
"""

ORACLES: dict[str, str] = {
    "p4_groups": _P4_GROUPS,
    "p5_found": _P5_FOUND,
    "p2_found": f"""
WITH v AS (SELECT seq, vector::DOUBLE[64] AS v FROM ({_CURRENT}) WHERE len(vector) = 64 AND list_sum([x * x for x in vector]) > 0),
s AS (SELECT a.seq AS seq, b.seq AS other, array_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.seq != b.seq),
t AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY c DESC, other) AS r FROM s)
SELECT DISTINCT least(seq, other) AS seq_a, greatest(seq, other) AS seq_b FROM t WHERE r <= 5 AND c >= 0.88
""",
    "p4_found": _P4_FOUND,
}
