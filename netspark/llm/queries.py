"""The queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard, line_dedup, merkle, mixing, periodic_runs, quality_model, quality_rules, substring_dedup, token_counts, toxicity, url_filter

URL_RULES: list[url_filter.Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(probe)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def _id_crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the periods that operator 11's contract plants in every tenth text; such texts are their words joined by spaces."""
    h = _id_crc()
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut_up = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    a = (F.col("g") % F.col("n")).cast("int")
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    placed = cut_up.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", period)
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {c: F.col(c) for c in merkle.FIELDS}
    tampered = merkle.leaf(fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    made = merkle.manifest(table(spark, sf_dir, "documents"), also={"tampered": F.when(_id_crc() % 3 == 0, tampered)})
    proved = made.proofs().withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_URL_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1), 'allow') AS verdict
FROM s"""

_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + CASE WHEN before IS NULL THEN 0 WHEN before = role THEN 8 ELSE 7 END
    + CASE WHEN before = role THEN 0 ELSE 9 + length(replace(replace(role, '%', '%25'), '|', '%7C')) END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + 7)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

_LEAK_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT p.r, p.i, k.k, k.item_id FROM p JOIN (SELECT DISTINCT k FROM k) ks ON p.i + ks.k - 1 <= len(p.w) JOIN k ON k.k = ks.k AND k.win = array_to_string(p.w[p.i:p.i + ks.k - 1], ' ')),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""

_JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id"""

_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, r, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS m FROM k GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT k.r, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN f ON k.g = f.g WHERE f.m < k.doc_id),
q AS (SELECT r, list(i) AS gone FROM x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE (SELECT coalesce(string_agg(w[i], ' ' ORDER BY i), '') FROM (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE NOT list_contains(gone, i)) END) AS kept_sha256
FROM d LEFT JOIN q USING (r)"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_LINES_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k FROM l),
f AS (SELECT k, max(doc_id) AS m FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT k.*, f.k IS NOT NULL AND k.doc_id IS DISTINCT FROM f.m AS gone FROM k LEFT JOIN f ON f.k = k.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""


#: crc32 of the decimal doc_id: the byte table by eight halvings, then a fold over the digits.
_CRC = (
    "c0 AS (SELECT i, i::BIGINT AS x FROM range(256) r(i))"
    + "".join(f", c{k + 1} AS (SELECT i, xor(x >> 1, (x & 1) * 3988292384) AS x FROM c{k})" for k in range(8))
    + """,
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), (SELECT list(x ORDER BY i) AS tab FROM c8))"""
)

#: A stretch that keeps period q for at least 6 words is a streak of equal 6-word windows q words apart.
_RUNS_SQL = rf"""
WITH {_CRC},
d AS (SELECT documents.doc_id, row_number() OVER () AS r, coalesce(h, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o FROM documents LEFT JOIN crc ON crc.doc_id = documents.doc_id),
p AS (SELECT *, 1 + (len(o) - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, (h // 10) % greatest(len(o), 1) AS a FROM d)),
t AS (SELECT doc_id, r, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN list_transform(range(len(o)), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS w FROM p),
g AS (SELECT r, i, len(w) AS n, array_to_string(w[i + 1:i + 6], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 5)) AS i FROM t WHERE len(w) >= 12)),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM m) GROUP BY r, q, k),
u AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
a AS (SELECT r, count(*) AS n_runs, max({{'l': length, 's': -start, 'p': -period}}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM u GROUP BY r),
x AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM u) GROUP BY r),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) t LEFT JOIN x ON x.r = t.r WHERE x.gone IS NULL OR NOT list_contains(x.gone, i) GROUP BY t.r)
SELECT t.doc_id, coalesce(a.n_runs, 0) AS n_runs, -a.best.s AS start, a.best.l AS length, -a.best.p AS period, 1000 * a.best.l // -a.best.p AS exponent_milli,
  sha256(coalesce(a.told, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM t LEFT JOIN a ON a.r = t.r LEFT JOIN k ON k.r = t.r"""


def _merkle_sql(levels: int = 8, over: int = 3) -> str:
    """The levels written out: enough for 8 ** levels rows of a group and 8 ** over groups."""
    sized = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(sized(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def up(name: str, n: int) -> str:
        out = "".join(f""",
{name}g{k} AS (SELECT tree, pos // 8 AS pos, any_value(width) AS width, list(d ORDER BY pos) AS ds FROM {name}{k} WHERE width > 1 GROUP BY 1, 2),
{name}{k + 1} AS (SELECT tree, pos, (width + 7) // 8 AS width, sha256(array_to_string(ds, '')) AS d FROM {name}g{k})""" for k in range(n))  # fmt: skip
        return out + f",\n{name}r AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE width = 1" for k in range(n + 1)) + ")"

    def fold(rows: str, name: str, n: int) -> str:
        out = ""
        for k in range(n):
            slot = f"((l.pos // {8**k}) % 8)"
            left, right = f"array_to_string(g.ds[1:{slot}], '')", f"array_to_string(g.ds[{slot} + 2:], '')"
            out += f""",
{rows}{k + 1} AS (SELECT l.* REPLACE (CASE WHEN g.ds IS NULL THEN l.f ELSE sha256({left} || l.f || {right}) END AS f, l.sib || coalesce({left} || {right}, '') AS sib)
  FROM {rows}{k} l LEFT JOIN {name}g{k} g ON g.tree = l.tree AND g.pos = l.pos // {8 ** (k + 1)})"""
        return out

    return f"""
WITH {_CRC},
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS d, {leaf(f"translate(text, {_AZ})")} AS low FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS width FROM leaves){up("a", levels)},
b0 AS (SELECT '' AS tree, tree AS of_tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS width, d FROM ar){up("b", over)},
x0 AS (SELECT a0.doc_id, tree, pos, d AS leaf, CASE WHEN coalesce(h, 1) % 3 = 0 THEN low ELSE d END AS f, '' AS sib FROM a0 LEFT JOIN crc ON crc.doc_id = a0.doc_id){fold("x", "a", levels)},
y0 AS (SELECT x.doc_id, x.leaf, b0.d AS subroot, b0.tree, b0.pos, x.f, x.sib FROM x{levels} x JOIN b0 ON b0.of_tree = x.tree){fold("y", "b", over)}
SELECT doc_id, leaf, subroot, br.d AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = br.d AS verified FROM y{over} y, br"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filter": op3_url_filter,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_quality_model": op8_quality_model,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL = {"op3_url_filter": _URL_SQL, "op4_decontamination": _LEAK_SQL, "op5_chat_format": _CHAT_SQL, "op7_ngram_jaccard": _JACCARD_SQL, "op10_substring_dedup": _SUBSTRING_SQL, "op11_periodic_runs": _RUNS_SQL, "op12_line_dedup": _LINES_SQL, "op13_merkle_manifest": _merkle_sql()}
