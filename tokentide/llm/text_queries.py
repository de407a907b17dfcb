"""Registered queries over whole texts: ranked search, sharding, spelling variants, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokentide.llm import lexical, shard_tree, spelling
from tokentide.llm.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by the usual table of remainders."""
    remainders = []
    for remainder in range(256):
        for _ in range(8):
            remainder = 0xEDB88320 ^ (remainder >> 1) if remainder & 1 else remainder >> 1
        remainders.append(str(remainder))
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = f"xor(a >> 8, [{','.join(remainders)}][(xor(a, b) & 255) + 1]::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {step}), 4294967295::BIGINT)"


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LEXICAL_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sums AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d),
held AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY row, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, sums GROUP BY term),
asked AS (SELECT item, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id,
               unnest(regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), sums GROUP BY item, row),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query(LEXICAL_SQL)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.search(docs.select("doc_id", "text"), items.select("item_id", "text"))


SHARDS = 40


def _unit_sql(path: str) -> str:
    return f"((CAST('0x' || substr(md5('{path}|' || key), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)"


def _descend_sql(shards: list[shard_tree.Shard], path: str, levels: tuple[str, ...]) -> str:
    """The shard below a node, as the place of the largest draw in a list of its children's."""
    level, *below = levels
    groups: dict[int, list[shard_tree.Shard]] = {}
    for shard in shards:
        groups.setdefault(getattr(shard, level), []).append(shard)
    inside = [
        _descend_sql(own, f"{path}/{level}{number}", tuple(below)) if below else str(own[0].number)
        for number, own in groups.items()
    ]
    if len(inside) == 1:
        return inside[0]
    draws = [
        f"ln({_unit_sql(f'{path}/{level}{number}')}) / {float(sum(shard.weight for shard in own))!r}::DOUBLE"
        for number, own in groups.items()
    ]
    best = f"list_position([{', '.join(draws)}], greatest({', '.join(draws)}))"
    return f"CASE {best} " + " ".join(f"WHEN {at} THEN {one}" for at, one in enumerate(inside, 1)) + " END"


def _shard_sql(shards: int) -> str:
    return f"({_descend_sql(shard_tree.tree(shards), '', ('region', 'rack', 'number'))})::INT"


SHARD_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
         {_crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
dealt AS (SELECT *, {_unit_sql("slot")} AS unit, {_shard_sql(SHARDS)} AS shard, {_shard_sql(SHARDS + 1)} AS grown_shard FROM sized)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY unit, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM dealt
"""


@query(SHARD_SQL)
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document among 40 and among 41, and its slot among the shard's rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_tree.assign(docs, shard_tree.tree(SHARDS), shard_tree.tree(SHARDS + 1))


SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all({_LOWER_SQL}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc32_sql("key || ':' || run")} AS h FROM runs),
told AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM told WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT cut.word, cut.n, w.word AS other, w.n AS other_n FROM cut JOIN words w ON cut.rest = w.word),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT * FROM shorter
  UNION ALL SELECT other, other_n, word, n FROM shorter),
best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, CASE WHEN other_n >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (
  SELECT word, word AS step FROM formed
  UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON ways.step = formed.word WHERE formed.form IS NOT NULL),
ends AS (SELECT ways.word, ways.step AS root FROM ways JOIN formed ON ways.step = formed.word WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query(SPELLING_SQL)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.word_counts(docs))
