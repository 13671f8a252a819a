"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, fingerprint, lm, mixing, packing, pii, quality, sharding, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.conversations(turns))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.stored_ledger(_table(spark, sf_dir, "documents")), quality.POLICIES["v2"])
    base = quality.POLICIES["v1"].rejects(F.col("failures"))
    alone = quality.only_rule(F.col("failures"), quality.POLICIES["v2"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failures", alone.alias("only_rule")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    extra = F.array_join(F.transform("extra", lambda x: F.concat(F.lit("term:"), x["start"], F.lit(":"), x["stop"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), extra)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.document_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(cut, packing.Limits())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.Mix(_table(spark, sf_dir, "documents")).rows()
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "key")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.with_next(_table(spark, sf_dir, "documents"))
    pairs = pairs.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_head")))
    pairs = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fp",
        "next_fp",
        fingerprint.packed(F.col("edited")).alias("efp"),
    )
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(F.col("fp")).alias("fingerprint"),
        fingerprint.as_text(F.col("efp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents"))
    per_word = F.round(F.col("log_score") / F.when(F.col("n_words") > 0, F.col("n_words")), 6)
    return scored.select("doc_id", "n_words", "n_seen", per_word.alias("mean_log_score"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex(F.get("words", F.lit(0))), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("first_id").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Pattern and test (over the match v and its digits) of each kind of personal data, in the order of the contract.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999))) <= 255"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        """length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(list_reverse(string_split(digits, '')),
           lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0""",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
}


def _placed(pattern: str, table: str, more: str = "") -> str:
    """SQL for the matches v of a pattern in the texts of a table, with start s and end e in code points."""
    cut = f"SELECT rid, regexp_extract_all(text, '{pattern}') AS vs, regexp_split_to_array(text, '{pattern}') AS gaps FROM {table}"
    each = f"SELECT rid, unnest(vs) AS v, unnest(gaps[:len(vs)]) AS gap, generate_subscripts(vs, 1) AS i FROM ({cut})"
    ends = f"SELECT rid, i, v, sum(length(gap) + length(v)) OVER (PARTITION BY rid ORDER BY i) AS e FROM ({each})"
    return f"SELECT rid, v, i, e - length(v) AS s, e{more} FROM ({ends})"


def pii_sql(rule: pii.Disclosure = pii.Disclosure()) -> str:
    """The whole result of ``op5_pii``: base spans by the patterns, disclosed terms by counting."""
    digits = ", regexp_replace(v, '[^0-9]', '', 'g') AS digits"
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, '{kind}' AS kind, s, e, v, digits FROM ({_placed(pattern, 'd', digits)}) WHERE {test}" for k, (kind, (pattern, test)) in enumerate(_KINDS.items())
    )
    bare = r"regexp_replace(v, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')"
    z, z2 = rule.z, rule.z**2
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        b AS (SELECT *, kind || ':' || CASE k WHEN 0 THEN lower(v) WHEN 1 THEN v ELSE digits END AS entity FROM ({found})),
        base AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS base, count(*) FILTER (k = 0) AS n_email,
                        count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone FROM b GROUP BY rid),
        own AS (SELECT * FROM d WHERE rid IN (SELECT rid FROM b)),
        w AS (SELECT *, {bare} AS term FROM ({_placed(r"[^\x20\x09-\x0D]+", "own")})),
        free AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s) - 1 AS place FROM w ANTI JOIN b ON w.rid = b.rid AND b.s < w.e AND b.e > w.s),
        m AS (SELECT b.rid, b.entity, b.k, b.s, count(free.s) FILTER (free.s < b.s) AS lo, count(free.s) FILTER (free.s < b.e) AS hi
              FROM b LEFT JOIN free USING (rid) GROUP BY b.rid, b.entity, b.k, b.s),
        near AS (SELECT m.rid, m.entity, m.k, m.s, list(term ORDER BY place) AS around
                 FROM m JOIN free ON free.rid = m.rid AND place >= lo - {rule.reach} AND place < hi + {rule.reach} AND term <> '' GROUP BY m.rid, m.entity, m.k, m.s),
        x AS (SELECT rid, entity, around, unnest(around) AS term FROM near),
        n AS (SELECT term, sum(n) AS n FROM (SELECT {bare} AS term, n FROM (SELECT v, count(*) AS n FROM (SELECT unnest({_WORDS}) AS v FROM d) GROUP BY v)) GROUP BY term),
        pairs AS (SELECT entity, term, count(DISTINCT around) AS support, count(*) AS together FROM x GROUP BY entity, term),
        y AS (SELECT *, together / greatest(together, coalesce(n.n, 0)) AS p, support / p AS o FROM pairs LEFT JOIN n USING (term)),
        chosen AS (SELECT entity, term FROM y WHERE (p + {z2} / 2 / o - {z} * sqrt(p * (1 - p) / o + {z2} / 4 / o / o)) / (1 + {z2} / o) >= {rule.generalise}),
        told AS (SELECT DISTINCT rid, term FROM x JOIN chosen USING (entity, term)),
        extra AS (SELECT rid, string_agg('term:' || a || ':' || a + length(term), ',' ORDER BY a) AS extra
                  FROM (SELECT rid, term, s + instr(v, term) - 1 AS a FROM free JOIN told USING (rid, term)) GROUP BY rid)
        SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
               coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, extra) AS spans
        FROM d LEFT JOIN base USING (rid) LEFT JOIN extra USING (rid)"""


ORACLE = {
    "op3_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
        t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY doc_id),
        m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                     coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM d LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 2 * n_words, word_chars > 15 * n_words,
                         100 * n_symbols > 20 * n_words, 100 * n_dup_lines > 50 * n_lines] AS b FROM m),
        x AS (SELECT *, list_sum(list_transform(b, lambda v, k: CASE WHEN v THEN 1 << (k - 1) ELSE 0 END))::BIGINT AS failures FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, n_lines, failures,
               CASE WHEN bit_count(failures) = 1 THEN ['few_words', 'repeated_windows', 'short_words', 'long_words', 'symbols', 'repeated_lines'][list_position(b, true)] END AS only_rule
        FROM x""",
    "op5_pii": pii_sql(),
    "op1_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '|', '\p')) + length(replace(replace(text, '\', '\\'), '<', '\l')) + 17 AS n FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(n)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_lm_scoring": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        n AS (SELECT count(*) AS total FROM t),
        u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
        c1 AS (SELECT w, c FROM u UNION ALL SELECT '<start> ', count(*) FROM d WHERE len(ws) > 0),
        b AS (SELECT doc_id, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '<start> ') AS a, w FROM t),
        c2 AS (SELECT a, w, count(*) AS c FROM b GROUP BY a, w),
        s AS (SELECT b.doc_id, (c2.c >= 2)::INT AS seen,
                     CASE WHEN c2.c >= 2 THEN ln(c2.c / x.c) ELSE ln(0.4) + ln(y.c / total) END AS score
              FROM b JOIN c2 USING (a, w) JOIN c1 x ON x.w = b.a JOIN c1 y ON y.w = b.w, n)
        SELECT d.doc_id, coalesce(count(score), 0)::BIGINT AS n_words, coalesce(sum(seen), 0)::BIGINT AS n_seen,
               round(sum(score) / count(score), 6) AS mean_log_score
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
