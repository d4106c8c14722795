"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .topk import top_k


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

QUERIES = {"op1_top_k_search": op1_top_k_search}
ORACLES = {"op1_top_k_search": OP1_SQL}
from .linedup import line_dedup
from .mixing import mix
from .sharding import written_shards
from .unitdup import repeated_units

#: Production parameters of op4: weights by level, of 60 % of all tokens, in 3 epochs at most. One source is shut out, so its
#: share goes to the others of its language and domain.
MIX = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "fr": 20, "de": 20, "es": 10}, "source": {"src3": 0}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), MIX, budget_share=0.6, max_epochs=3, seed=17)
    return out.select(F.col("record.doc_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"), window=3).select("doc_id", "n_lines", "n_removed_lines", "text")


#: op8 removes repeated passages: lines of so many words, and so many words from content-defined points, anywhere in a text.
#: Shorter lines on their own (a title, a licence line) recur in half of all documents; ``unit_dedup_lines`` has them all.
OP8_WORDS, OP8_PICK = 25, 20


def op8_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of OP8_WORDS words and more, and repeated passages wherever they begin and end."""
    return repeated_units(read(spark, sf_dir, "documents"), unit=("line", "passage"), min_words=OP8_WORDS, span=OP8_WORDS, pick=OP8_PICK).drop("text_key")


def unit_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of any length."""
    return repeated_units(read(spark, sf_dir, "documents"), unit="line").drop("text_key")


def unit_dedup_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs of any length."""
    return repeated_units(read(spark, sf_dir, "documents"), unit="paragraph").drop("text_key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = written_shards(read(spark, sf_dir, "documents"), shards=8, seed=7)
    return out.select("record.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_W = r"'[^\x20\x09-\x0D]+'"


def _weight_sql(level: str, weights: dict) -> str:
    given = weights[level]
    return f"(CASE {' '.join(f"""WHEN {level} = '{k}' THEN {v}""" for k, v in given.items())} ELSE 1 END)" if given else "1"


def _caps_sql(weights: dict, epochs: int) -> str:
    """What each node can take at most: its leaves' epochs, nothing under a weight of 0; from the leaves up."""
    leaf = ["domain", "lang", "source"]
    out = [f"cap3 AS (SELECT {', '.join(leaf)}, CASE WHEN {_weight_sql('source', weights)} > 0 THEN supply * {epochs} ELSE 0 END::HUGEINT AS cap FROM leaf)"]
    for k in (2, 1):
        cols = ", ".join(leaf[:k])
        out.append(f"cap{k} AS (SELECT {cols}, CASE WHEN {_weight_sql(leaf[k - 1], weights)} > 0 THEN sum(cap) ELSE 0 END::HUGEINT AS cap FROM cap{k + 1} GROUP BY {cols})")
    return ",\n".join(out)


def _fill_sql(name: str, above: str, path: list[str], weights: dict) -> str:
    """A node is full if, with all siblings raised to its own level of cap by weight, no more than the budget is taken.

    The others share what the full ones leave, by weight.
    """
    on = " AND ".join([f"x.{c} = y.{c}" for c in path[:-1]]) or "TRUE"
    cols = ", ".join(path)
    budget = f"JOIN {above} p USING ({', '.join(path[:-1])})" if path[:-1] else f", {above} p"
    return f"""
{name}_0 AS (SELECT n.*, p.alloc AS budget, {_weight_sql(path[-1], weights)}::HUGEINT AS weight FROM cap{len(path)} n {budget}),
{name}_1 AS (SELECT x.*, (SELECT sum(least(y.cap * x.weight, x.cap * y.weight)) FROM {name}_0 y WHERE {on} AND y.weight > 0) <= x.budget * x.weight AS "full" FROM {name}_0 x WHERE x.weight > 0),
{name}_2 AS (SELECT x.*, budget - (SELECT coalesce(sum(cap), 0) FROM {name}_1 y WHERE {on} AND y."full") AS rest, (SELECT sum(weight) FROM {name}_1 y WHERE {on} AND NOT y."full") AS rest_w FROM {name}_1 x),
{name} AS (SELECT {cols}, CASE WHEN "full" THEN cap ELSE (rest * weight) // rest_w END AS alloc FROM {name}_2)"""


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, {_W})), 0) AS n_tokens,
    CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 'other' ELSE 'd' || (TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4) END AS domain
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS supply FROM d GROUP BY ALL),
{_caps_sql(MIX, 3)},
root AS (SELECT least(floor((SELECT sum(supply) FROM leaf)::DOUBLE * 0.6)::HUGEINT, (SELECT sum(cap) FROM cap1)) AS alloc),
{_fill_sql("a", "root", ["domain"], MIX)},
{_fill_sql("b", "a", ["domain", "lang"], MIX)},
{_fill_sql("c", "b", ["domain", "lang", "source"], MIX)},
plan AS (SELECT domain, lang, source, coalesce(alloc // nullif(supply, 0), 0) AS whole, coalesce(alloc % nullif(supply, 0), 0) AS rest FROM c JOIN leaf USING (domain, lang, source)),
k AS (SELECT d.*, p.whole, p.rest, md5('17:' || (p.whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN plan p USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
e AS (SELECT *, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM s)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(1, copies + 1)) AS epoch FROM e WHERE copies > 0
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS win
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)
  WHERE NOT regexp_full_match(l[i + 1] || l[i + 2] || l[i + 3], '[ \t\x0B\f\r]*')
), r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM r),
t AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT d.doc_id, d.text, d.l, coalesce(t.gone, []) AS gone FROM d LEFT JOIN t USING (doc_id)),
y AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM
  (SELECT doc_id, gone, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM x WHERE len(gone) > 0) WHERE NOT list_contains(gone, i) GROUP BY doc_id)
SELECT x.doc_id, len(l)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed_lines, CASE WHEN len(gone) = 0 THEN text ELSE coalesce(kept, '') END AS text
FROM x LEFT JOIN y USING (doc_id)
"""


def _lines_sql(words: int) -> str:
    return rf"""
ld AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lu AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS unit FROM ld),
lo AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS start FROM lu),
ln AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM lo WHERE len(regexp_extract_all(line, {_W})) >= {words}),
lf AS (SELECT *, row_number() OVER g AS r, first_value(doc_id) OVER g AS kept_doc_id, first_value(unit) OVER g AS kept_unit FROM ln WINDOW g AS (PARTITION BY norm ORDER BY doc_id, unit)),
lines AS (SELECT doc_id, 'line' AS kind, unit, start::BIGINT AS start, length(line)::BIGINT AS length, kept_doc_id, kept_unit FROM lf WHERE r > 1)"""


#: Words with their places; a word's key from its bytes, last to first; the last least key of each OP8_PICK places.
_PASSAGES_SQL = rf"""
pd AS (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS toks FROM documents WHERE text IS NOT NULL),
pt AS (SELECT doc_id, len(toks) - {OP8_WORDS} + 1 AS m, unnest(toks) AS tok, unnest(range(0, len(toks))) AS i FROM pd WHERE len(toks) >= {OP8_WORDS}),
pw AS (SELECT doc_id, m, i, regexp_extract(tok, {_W}) AS word, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM pt),
dk AS (SELECT word, list_reduce(list_prepend(0::BIGINT, list_transform(range(length(hex(lower(word))) // 2 - 1, -1, -1), lambda j: ('0x' || substr(hex(lower(word)), 2 * j + 1, 2))::BIGINT)),
  lambda h, b: (h * 2654435761 + b + 1) % 2147483648) AS key FROM (SELECT DISTINCT word FROM pw)),
pk AS (SELECT pw.*, key FROM pw JOIN dk USING (word)),
pv AS (SELECT doc_id, i, m, min(key * 4294967296 + 4294967295 - i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {OP8_PICK - 1} FOLLOWING) AS v FROM pk WHERE i < m),
ps AS (SELECT DISTINCT doc_id, 4294967295 - v % 4294967296 AS unit FROM pv WHERE i <= greatest(0, m - {OP8_PICK})),
pg AS (SELECT ps.doc_id, ps.unit, string_agg(lower(word), ' ' ORDER BY i) AS norm, min(upto - length(word)) AS start, max(upto) AS stop FROM ps JOIN pk ON pk.doc_id = ps.doc_id AND pk.i BETWEEN ps.unit AND ps.unit + {OP8_WORDS - 1} GROUP BY ALL),
pf AS (SELECT *, row_number() OVER g AS r, first_value(doc_id) OVER g AS kept_doc_id, first_value(unit) OVER g AS kept_unit FROM pg WINDOW g AS (PARTITION BY norm ORDER BY doc_id, unit)),
passages AS (SELECT doc_id, 'passage' AS kind, unit::BIGINT AS unit, start::BIGINT AS start, (stop - start)::BIGINT AS length, kept_doc_id, kept_unit::BIGINT AS kept_unit
  FROM pf WHERE r > 1 AND NOT (doc_id = kept_doc_id AND unit - kept_unit < {OP8_WORDS}))"""

OP8_SQL = f"WITH {_lines_sql(OP8_WORDS)}, {_PASSAGES_SQL} SELECT * FROM lines UNION ALL SELECT * FROM passages"
LINES_SQL = f"WITH {_lines_sql(1)} SELECT * FROM lines"

QUERIES |= {"op4_mixing": op4_mixing, "op7_line_dedup": op7_line_dedup, "op8_unit_dedup": op8_unit_dedup, "unit_dedup_lines": unit_dedup_lines, "unit_dedup_paragraphs": unit_dedup_paragraphs, "op9_sharding": op9_sharding}
ORACLES |= {"op4_mixing": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_unit_dedup": OP8_SQL, "unit_dedup_lines": LINES_SQL}

from .packing import pack  # noqa: E402
from .quality import quality_report  # noqa: E402


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), length=4096, end_id=2)


QUERIES |= {"op2_quality_rules": op2_quality_rules, "op5_packing": op5_packing}

from .htmltext import extract  # noqa: E402


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES |= {"op3_html_extraction": op3_html_extraction}

from .jaccard import near_duplicates  # noqa: E402


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=5, percent=80)


QUERIES |= {"op10_jaccard_join": op10_jaccard_join}

from .suffix import substring_dedup  # noqa: E402


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), length=200)


QUERIES |= {"op6_suffix_dedup": op6_suffix_dedup}

from .codes import vector_codes  # noqa: E402


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Full searches in place of the annuli; one assignment and one move of the entries a round. Sums of doubles that hold whole numbers."""
    out = [f"""
k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, v FROM (SELECT vec_id, min(v) AS v FROM k GROUP BY vec_id) ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS c FROM s, (SELECT unnest(range({parts})) AS part))"""]
    for t in range(rounds + 1):
        out.append(f"""
d{t} AS MATERIALIZED (SELECT r, part, x, entry, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS dist FROM p JOIN b{t} USING (part)),
a{t} AS MATERIALIZED (SELECT * FROM d{t} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY dist, entry) = 1)""")
        if t < rounds:
            out.append(f"""
m{t} AS (SELECT part, entry, place, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{t}) GROUP BY ALL),
n{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n)::DOUBLE / n ORDER BY place) AS c FROM m{t} GROUP BY ALL),
b{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{t}.c, b{t}.c) AS c FROM b{t} LEFT JOIN n{t} USING (part, entry))""")
    return f"""WITH {",".join(out)},
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS c, unnest(range(len(c))) AS place FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (r), h"""


QUERIES |= {"op13_vector_codes": op13_vector_codes}
ORACLES |= {"op13_vector_codes": _codes_sql(8, 16, 6, 4096)}

from .align import align  # noqa: E402


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES |= {"op12_token_alignment": op12_token_alignment}

from .language import identify  # noqa: E402


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


QUERIES |= {"op11_language_id": op11_language_id}
