"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import chat, decontaminate, exact_dedup, fim, licenses, packing, quality, ranked_search, secrets_scan, simhash, substrings, token_counts, token_shards
from tremor.llm.common import read_table, scratch

END_ID = 2


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = scratch(spark, "op1")
    token_shards.write_token_shards(spark, docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)
    return token_shards.digests(spark, path, docs)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found, _ = decontaminate.decontaminate(spark, docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, read_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_lines(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "weak_posterior", "score", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat.format_conversations(rows.unionByName(extra))
    read = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                            chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = fim.fill_in_middle(spark, read_table(spark, sf_dir, "documents"), salt="1")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(spark, read_table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return ranked_search.search(spark, docs, benchmark, k=10).select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_secret_scan, op3_decontaminate, op4_token_counts, op5_exact_dedup, op6_packing,
                                   op7_license_scan, op8_quality, op9_simhash, op10_chat_format,
                                   op11_fill_in_middle, op12_substring_dedup, op13_ranked_search)}


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
          FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
          FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM asked) WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, item_id, i, size FROM grams JOIN asked USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(low) AS text_sha256
FROM (SELECT doc_id, {LOW.format('text')} AS low FROM documents) WINDOW same AS (PARTITION BY low)
"""

BIGRAMS = """CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) ELSE [] END"""
WORDS = "string_split(trim(regexp_replace({}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ')"

OP7_SQL = f"""
WITH wording AS (SELECT name, {BIGRAMS} AS grams FROM (SELECT name, {WORDS.format(LOW.format('t'))} AS w FROM (VALUES
    {", ".join(f"({sql_text(name)}, {sql_text(text)})" for name, texts in licenses.TEMPLATES.items() for text in texts)}) AS v(name, t))),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
paragraphs AS (SELECT row, doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM docs),
lines AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS unit, 'line' AS kind FROM docs
          UNION ALL SELECT row, doc_id, text, -1, 'text' FROM docs WHERE contains(text, chr(10))
          UNION ALL SELECT row, doc_id, unnest(p), unnest(range(0, len(p))), 'paragraph' FROM paragraphs WHERE len(p) > 1),
units AS (SELECT row, doc_id, kind, unit, {BIGRAMS} AS grams FROM (SELECT row, doc_id, kind, unit, {WORDS.format(LOW.format('s'))} AS w FROM lines)),
scored AS (SELECT row, doc_id, kind, unit, name, 2.0 * len(list_intersect(units.grams, wording.grams)) / (len(units.grams) + len(wording.grams)) AS dice
           FROM units, wording WHERE len(units.grams) > 0 AND len(units.grams) < 3 * len(wording.grams) AND len(wording.grams) < 3 * len(units.grams)),
anchor AS (SELECT * FROM (VALUES {", ".join(f"({sql_text(w)}, {t}, {n}, {size}, {sql_text(licenses.template_bigrams(licenses.TEMPLATES)[t][0])})" for w, t, n, size in licenses.anchors(licenses.TEMPLATES, 0.8))}) AS v(word, t, n, size, name)),
template AS (SELECT t, {BIGRAMS} AS wanted FROM (SELECT t, {WORDS.format(LOW.format('said'))} AS w FROM (VALUES
    {", ".join(f"({t}, {sql_text(text)})" for t, text in enumerate(x for _, texts in sorted(licenses.TEMPLATES.items()) for x in texts))}) AS v(t, said))),
wide AS (SELECT row, doc_id, {WORDS.format(LOW.format('text'))} AS w FROM docs),
spots AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM wide),
starts AS (SELECT DISTINCT spots.row, t, size, name, i - n AS unit FROM spots JOIN anchor USING (word) WHERE i >= n),
cut AS (SELECT starts.row, doc_id, t, unit, name, unit + size AS stop, w[unit + 1:unit + size] AS w FROM starts JOIN wide USING (row) WHERE unit + size <= len(wide.w)),
slid AS (SELECT row, doc_id, unit, name, stop, 2.0 * len(list_intersect(grams, wanted)) / (len(grams) + len(wanted)) AS dice
         FROM (SELECT row, doc_id, t, unit, name, stop, {BIGRAMS} AS grams FROM cut) JOIN template USING (t)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, name ORDER BY dice DESC, unit, stop) AS place FROM slid WHERE dice >= 0.8) WHERE place = 1),
every AS (SELECT doc_id, kind, unit, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY row, kind, unit ORDER BY dice DESC, name) AS place FROM scored WHERE dice >= 0.8) WHERE place = 1
          UNION ALL SELECT doc_id, 'window', unit, name, dice FROM top h WHERE NOT EXISTS (SELECT 1 FROM top g WHERE g.row = h.row AND g.unit < h.stop AND h.unit < g.stop
                                                                                          AND (g.dice > h.dice OR g.dice = h.dice AND g.name < h.name)))
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, name AS license, round(CAST(dice AS DOUBLE), 6) AS dice FROM every
"""

OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\*)(<\|[^|<>]*\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\\\1\2', 'g')) AS size,
             role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS merged FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size + CASE WHEN merged THEN 9 ELSE 12 + length(role) + 1 + 12 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11_SQL = """
WITH t AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h
           FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents)),
c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1:least(a, b)], '') AS prefix, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle,
             array_to_string(w[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS spot FROM (SELECT row, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM d),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY spot) AS kept, count(*) AS n FROM words ANTI JOIN hit USING (row, spot) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOW.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({LOW.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
post AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY row, term),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM b) GROUP BY item, item_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(size.docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, size GROUP BY term),
norm AS (SELECT row, doc_id, 25 + (75 * len(w) * docs) // terms AS m FROM d, size),
scored AS (SELECT item, item_id, row, doc_id, CAST(sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM asked JOIN post USING (term) JOIN weight USING (term) JOIN norm USING (row) GROUP BY item, item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_license_scan": OP7_SQL, "op10_chat_format": OP10_SQL,
                           "op11_fill_in_middle": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}
