"""The registered queries of this subpackage and their SQL.

A query applies its operator, with production parameters, to the whole table it is for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, chat, decontam, html_extract, line_dedup, near_dedup, quality_rules, repair, sharding, substring_dedup, token_counts, warc, whitening
from eventloom.llm._shared import kept, shared_dir, small_or_shuffled

#: Ids beyond this number are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Versions of word tokenizers: ASCII-space words; runs of letters and digits, and single marks.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"}
BPE = "byte_bpe_multi_50k"


def _counts(rows: DataFrame) -> DataFrame:
    """Rows (…, text) with a count for each tokenizer version in the text's place."""
    by_pattern = rows.withColumns({name: token_counts.counted(F.col("text"), p) for name, p in TOKENIZERS.items()})
    return token_counts.with_bpe_count(by_pattern, BPE, *_ranks())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by two patterns and a BPE vocabulary after four commits: all documents are inserted; the
    toxic ones are deleted; of the others those of quality 0 are revised to their texts without
    symbols; the second batch is committed again, which changes nothing."""
    documents = _table(spark, sf_dir, "documents")
    docs = kept(_counts(documents.select("doc_id", "lang", "source", "text")), "token-counts")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = kept(docs.join(labels, "doc_id"), "token-labelled")
    toxic, poor = known.where("toxic = 1"), known.where("coalesce(toxic, 0) <> 1 AND quality = 0")
    ids = poor.select("doc_id").distinct()
    bare = documents.join(small_or_shuffled(ids, ids.count(), MOST_BROADCAST), "doc_id").select("doc_id", "lang", "source", F.regexp_replace("text", r"[#*$%&|<>]", "").alias("text"))
    names = [*TOKENIZERS, BPE]
    new, old = kept(_counts(bare), "token-bare"), {name: F.col(name) for name in names}
    ledger = token_counts.Ledger(spark, f"{shared_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    ledger.commit(1, token_counts.changes_of(docs, "insert", old))
    ledger.commit(2, token_counts.changes_of(toxic, "delete", old))
    # a revision is the new count less the old one; each side is summed on its own, so rows needn't meet
    none = {name: F.lit(0) for name in names}
    revised = token_counts.changes_of(new, "revise", old, none).unionByName(token_counts.changes_of(poor, "revise", none, old))
    ledger.commit(3, revised)
    ledger.commit(2, token_counts.changes_of(toxic, "delete", old))
    return ledger.totals()


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back; a record that isn't whole ends the query with an error."""
    pages = _table(spark, sf_dir, "pages")
    records = warc.read_records(warc.write_chunks(pages)).where("record_type IS NULL OR record_type <> 'warcinfo'")
    kind = pages.schema["page_id"].dataType
    whole = F.when(F.col("intact"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce("record_id", F.lit("null")))))
    return records.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", whole.cast("string").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def _ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), *_ranks())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.measure(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(chat.events_of(turns.unionByName(extra))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``rows``: counts of any two shards are at most one apart."""
    dealt = sharding.shuffled(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    return dealt.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(turns), turns)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    each = rows.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_token_counts, op3_html_extraction, op4_decontamination, op5_warc, op6_bpe,
        op7_quality_rules, op8_chat_formatting, op9_line_dedup, op10_near_dedup,
        op11_sharding, op12_conversation_repair, op13_whitening, pipeline,
    )
}  # fmt: skip

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM twice)), (SELECT unnest(range(35)) AS k)),
per AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT coalesce(list_contains(ps, i), false)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

WORD_COUNTS = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, CASE WHEN quality = 0 THEN regexp_replace(text, '[#*$%&|<>]', '', 'g') ELSE text END AS t
      FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
c AS (SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(t, ''), '[^\x20\x09-\x0D]+')) AS n FROM d
      UNION ALL SELECT source, lang, 'words-2', len(regexp_extract_all(coalesce(t, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""

_NORMAL = r"[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

_OP4 = rf"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents), b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
win AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, i, size, item_id FROM win JOIN bw USING (size, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
x AS (SELECT *, [list_sum([(instr('0123456789abcdef', h[5 * g + j + 1]) - 1) * (16 ** (4 - j))::BIGINT FOR j IN range(5)])::BIGINT FOR g IN range(8)] AS g20 FROM f)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v // (32 ** (3 - k))::BIGINT) % 32) + 1] FOR k IN range(4)], '') FOR v IN g20], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM x
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([5, 7, 10, 13]) AS n) WHERE len(w) >= n)),
rep AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS p FROM rep),
share AS (SELECT doc_id, n, count(*) AS words, sum(length(w[p])) AS chars FROM cov JOIN d USING (doc_id) GROUP BY doc_id, n),
per AS (SELECT doc_id, max(words) FILTER (n = 5) AS rw, max(chars) FILTER (n = 5) AS c5, max(chars) FILTER (n = 7) AS c7, max(chars) FILTER (n = 10) AS c10, max(chars) FILTER (n = 13) AS c13 FROM share GROUP BY doc_id),
ln AS (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dup AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * length(l)) AS chars FROM ln GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rw, 0)::BIGINT AS n_repeat_words, coalesce(c5, 0) AS c5, coalesce(c7, 0) AS c7, coalesce(c10, 0) AS c10, coalesce(c13, 0) AS c13,
  coalesce(dup.chars, 0) AS dc, length(t) AS chars FROM d LEFT JOIN per USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 10 * dc <= 3 * greatest(chars, 1) AND 10 * n_symbols <= 3 * n_words
  AND 100 * c5 <= 25 * greatest(word_chars, 1) AND 100 * c7 <= 24 * greatest(word_chars, 1) AND 100 * c10 <= 22 * greatest(word_chars, 1) AND 100 * c13 <= 20 * greatest(word_chars, 1) AS kept
FROM m
"""

_OP8 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + length(text) + length(regexp_extract_all(text, '\\|###|</turn>')) + length(regexp_extract_all(role, '\\|###|</turn>|:|\n')) + 14)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, i, ls[i] AS l, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS keep FROM e WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT e.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM e LEFT JOIN g USING (k)) GROUP BY doc_id
"""

_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""

def _crc32(row: str) -> str:
    """CRC-32 of the bytes in list ``row``, bit by bit."""
    bits = f"flatten([[b, -1, -1, -1, -1, -1, -1, -1, -1] FOR b IN {row}])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _least(*ways: str) -> str:
    """The way of least cost, of ties that with the ASCII-least edits; a way is {c, a, t}: cost, edits, text."""
    return "list_sort([" + ", ".join(ways) + "])[1]"


def _way(state: str, cost: str, edit: str, line: str, only: str = "true") -> str:
    return f"CASE WHEN {only} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} ELSE {{'c': 1000000, 'a': '', 't': ''}} END"


_U, _A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEPT = "chr(10) || role || ':' || txt"
_ROLE_U, _ROLE_A = "chr(10) || 'user:' || txt", "chr(10) || 'assistant:' || txt"


def _rows_out(state: str) -> str:
    """The least ways to end in ``state`` (z nothing, s, u, a) after a row, from the ways before it, rows inserted before it included."""
    gone = _way("isy" if state == "s" else f"i{state}", "3", "D", "''")
    if state == "z":
        return gone
    if state == "s":
        return _least(gone, _way("iz", "cut", "K", _KEPT, "NOT must AND r = 's'"))
    if state == "u":
        return _least(gone, *[_way(q, "cut", "K", _KEPT, "NOT must AND r = 'u'") for q in ("iz", "isy", "ia")], *[_way(q, "2 + cut", "R", _ROLE_U, "NOT must") for q in ("iz", "isy", "ia")])
    return _least(gone, _way("iu", "cut", "K", _KEPT, "NOT must AND r = 'a'"), _way("iu", "2 + cut", "R", _ROLE_A, "NOT must"))


_NONE = "{'c': 1000000, 'a': '', 't': ''}"
#: The ways after rows are inserted: into u from nothing, s or a, into a from u, twice at most.
_INSERTED = f"""SELECT *, {_least("u1", _way("a1", "2", "I", _U))} AS iu, a1 AS ia FROM (SELECT *, {_least("ua", _way("u1", "2", "I", _A))} AS a1
  FROM (SELECT *, {_least("uu", _way("uz", "2", "I", _U), _way("us", "2", "I", _U), _way("ua", "2", "I", _U))} AS u1 FROM %s))"""

_OP12 = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    [ord(x) FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS k FROM conversations),
h AS (SELECT *, {_crc32("k")} % 20 AS fault FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt FROM h, range(2) t(n) WHERE fault <> 0 AND (n = 0 OR fault = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i FROM dam),
f0 AS (SELECT *, substring(role, 1, 1) AS r, lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
    NOT regexp_matches(txt, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 AS dup,
    NOT regexp_matches(txt, '[.!?][ 	-]*$') AS trunc FROM num),
f AS (SELECT *, blank OR dup AS must, (NOT blank AND NOT dup AND trunc)::INT AS cut FROM f0),
facts AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END::BIGINT AS gaps,
    count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup AND NOT blank)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated,
    count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM f GROUP BY conv_id),
w AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS uz, {_NONE} AS us, {_NONE} AS uu, {_NONE} AS ua FROM facts
  UNION ALL
  SELECT conv_id, i + 1, {_rows_out("z")}, {_rows_out("s")}, {_rows_out("u")}, {_rows_out("a")}
  FROM (SELECT *, uz AS iz, us AS isy FROM ({_INSERTED % "(SELECT w.*, f.role, f.txt, f.r, f.must, f.cut FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)"}))
),
fin AS (SELECT conv_id, {_least("uz", "ua", "a1")} AS best FROM ({_INSERTED % "(SELECT w.* FROM w JOIN facts ON facts.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = facts.n)"})),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substring(best.t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

#: Where SQL can't express a query (2's BPE counts, 3, 6, 11, 13, pipeline) tests hold it against a brute-force
#: version; ``WORD_COUNTS`` is the SQL of op2's two pattern tokenizers, which its test runs.
ORACLE: dict[str, str] = {
    "op1_substring_dedup": _OP1, "op4_decontamination": _OP4, "op5_warc": _OP5, "op7_quality_rules": _OP7,
    "op8_chat_formatting": _OP8, "op9_line_dedup": _OP9, "op10_near_dedup": _OP10, "op12_conversation_repair": _OP12,
}  # fmt: skip
