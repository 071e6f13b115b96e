"""The registered queries of the training-text operators, and their SQL where there is any.

Each query reads whole tables, passes them through its operator with production
parameters and derives the columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlens.sources.checkpoints import scratch_dir

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Law ``rows``: counts of shards at most one apart."""
    from burstlens.llm.sharding import shard_by_mixture

    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, d).select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_by_mixture(rows, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_language_id(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.language_id import fit_language, identify_language

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = _documents(spark, d)
    model = fit_language(docs.filter(~held_out).select("doc_id", "text", "lang"))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.decontaminate import find_contamination

    docs = _documents(spark, d).select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.warc import page_number, read_warc, write_warc

    path = scratch_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{d}/pages.parquet"), path)
    return (
        read_warc(spark, path)
        .filter(F.col("gap").isNull())
        .select(
            page_number(F.col("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            page_number(F.col("refers_to")).alias("refers_to"),
        )
    )


def op5_token_files(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.token_files import read_token_files, write_token_files

    path = scratch_dir(spark, "tokens")
    write_token_files(_documents(spark, d), path, BYTE_BPE, end_id=0)
    return read_token_files(spark, path)


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.quality import fit_quality, score_quality

    docs = _documents(spark, d).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return score_quality(docs, model).drop("text")


def op7_simhash_duplicates(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.simhash import near_duplicates

    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return near_duplicates(_documents(spark, d)).select(
        "doc_id", digits.alias("fingerprint"), "component_id"
    )


def op8_bpe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.word_bpe import roundtrip_digests

    docs = _documents(spark, d).select("doc_id", "text")
    return roundtrip_digests(docs, WORD_BPE).drop("text")


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.token_counts import count_tokens

    docs = _documents(spark, d).select("doc_id", "text")
    return count_tokens(docs, BYTE_BPE).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def _crc_steps() -> list[int]:
    """What a byte does to a CRC-32: eight halvings, each with the polynomial if odd."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 * (x % 2)) for x in table]
    return table


_SHARDS_SQL = f"""
WITH raw AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS digits FROM documents),
  d AS (SELECT doc_id, source, len(digits) // 2 + 1 AS size,
      xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(len(digits) // 2), lambda i: CAST(('0x' || digits[2 * i + 1:2 * i + 2]) AS BIGINT))),
        lambda c, b: xor(c >> 8, list_extract({_crc_steps()}, xor(c & 255, b) + 1)))) AS text_crc32,
      coalesce(source, '') AS s, source IS NULL AS none,
      CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '\u2205')), 1, 15)
           AS BIGINT) AS k
    FROM raw),
  r AS (SELECT *, row_number() OVER (PARTITION BY s, none
                                     ORDER BY k, doc_id, source, size, text_crc32) - 1 AS i,
               count(*) OVER (PARTITION BY s, none) AS n FROM d),
  p AS (SELECT *, row_number() OVER (ORDER BY (i + CAST(0.5 AS DOUBLE)) / n, s, none, k,
                                     doc_id, source, size, text_crc32) - 1 AS place,
               count(*) OVER () AS total FROM r),
  c AS (SELECT *, (place * 16) // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       place - (shard * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM c"""


_WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_CONTAMINATION_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS l FROM documents),
  b AS (SELECT item_id, {_WORDS_SQL} AS l FROM benchmark),
  starts AS (SELECT item_id, l, least(len(l), 10) AS n,
      unnest(range(1, greatest(len(l) - 9, 1) + 1)) AS i FROM b WHERE len(l) > 0),
  phrases AS (SELECT DISTINCT item_id, n, array_to_string(l[i:i + n - 1], ' ') AS p FROM starts),
  sizes AS (SELECT DISTINCT n FROM phrases),
  places AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w),
  grams AS (SELECT doc_id, i, n, array_to_string(l[i:i + n - 1], ' ') AS p
      FROM places, sizes WHERE i + n - 1 <= len(l)),
  hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN phrases USING (n, p)),
  covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j
      FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
  n_hits AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
  names AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits),
  n_names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS ids
      FROM names GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n_hits USING (doc_id) LEFT JOIN n_names USING (doc_id)"""


_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d
           FROM pages),
  g AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (d)"""


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.toxicity import fit_toxicity, score_toxicity

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = _documents(spark, d).select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").filter(~held_out)
    found = score_toxicity(docs, fit_toxicity(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_merkle(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.merkle import folded, leaf_digest, proof_digest, with_proofs
    from burstlens.llm.places import written

    docs = _documents(spark, d)
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_digest(fields | {"n_chars": F.col("n_chars") + 1})
    # Texts are read once; what follows are digests.
    leaves = written(
        docs.select("doc_id", "lang", leaf_digest(fields).alias("leaf"), F.when(tampered, changed).alias("changed")),
        "leaves",
    )
    found = with_proofs(leaves, "lang", ["doc_id"])
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_MERKLE_SQL = """
WITH RECURSIVE parts AS (SELECT doc_id, lang, n_chars, crc32 % 7 = 0 AS tampered, {head} AS head, {tail} AS tail
    FROM (SELECT *, {crc} AS crc32 FROM documents)),
  leaves AS (SELECT doc_id, lang, sha256(head || {n_chars} || tail) AS leaf,
      sha256(head || {n_plus} || tail) AS changed, tampered FROM parts),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g FROM leaves),
  low AS (SELECT g, 0 AS level, pos, leaf AS h, n FROM ranked
    UNION ALL
    SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM low WHERE n > 1 GROUP BY g, level, pos // 2, n),
  tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
  high AS (SELECT 0 AS level, pos, h, n FROM tops
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
    FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
  -- Siblings of every node with more than one node on its level, and the depth of each tree.
  low_step AS (SELECT a.g, a.level, a.pos, b.h AS s FROM low a
    LEFT JOIN low b ON b.g = a.g AND b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
  high_step AS (SELECT a.level, a.pos, b.h AS s FROM high a
    LEFT JOIN high b ON b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
  depth AS (SELECT g, max(level) AS d FROM low GROUP BY g),
  steps AS (SELECT r.g, r.pos, l.level AS k, l.s, (r.pos >> l.level) % 2 AS slot
    FROM ranked r JOIN low_step l ON l.g = r.g AND l.pos = r.pos >> l.level
    UNION ALL
    SELECT r.g, r.pos, d.d + h.level, h.s, (t.pos >> h.level) % 2
    FROM ranked r JOIN depth d USING (g) JOIN tops t USING (g) JOIN high_step h ON h.pos = t.pos >> h.level),
  proofs AS (SELECT g, pos, sha256(coalesce(string_agg(s, '' ORDER BY k), '')) AS proof_sha256, count(*) AS m
    FROM steps GROUP BY g, pos),
  fold AS (SELECT g, pos, 0 AS k, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM ranked
    UNION ALL
    SELECT f.g, f.pos, f.k + 1, sha256(CASE WHEN s IS NULL THEN f.h WHEN slot = 1 THEN s || f.h ELSE f.h || s END)
    FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.k = f.k),
  ends AS (SELECT g, pos, arg_max(h, k) AS folded_root FROM fold GROUP BY g, pos)
SELECT doc_id, leaf, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM high WHERE n = 1) AS verified
FROM ranked r JOIN tops t USING (g) JOIN ends e ON e.g = r.g AND e.pos = r.pos
LEFT JOIN proofs p ON p.g = r.g AND p.pos = r.pos"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _crc_sql(text: str) -> str:
    """CRC-32 of a short text of ASCII characters."""
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
        lambda c, b: xor(c >> 8, list_extract({_crc_steps()}, xor(c & 255, b) + 1))))"""


def _merkle_sql() -> str:
    return _MERKLE_SQL.format(
        crc=_crc_sql("CAST(doc_id AS VARCHAR)"),
        head=" || ".join(map(_field_sql, ("doc_id", "source", "lang"))),
        tail=_field_sql("text"),
        n_chars=_field_sql("n_chars"),
        n_plus=_field_sql("(n_chars + 1)"),
    )


def op11_license_scan(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.licenses import license_digest, scan_licenses

    found = license_digest(scan_licenses(_documents(spark, d).select("doc_id", "text")))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def _licenses_sql() -> str:
    """Every word of a notice against every word of a text, by relative position."""
    from burstlens.llm.licenses import BASE, NOTICES

    every = (*BASE, *NOTICES)
    heads = ", ".join(
        f"({n}, '{o.label}', {len(o.tokens)}, {o.needed}, {len(o.mandatory)}, {str(n < len(BASE)).lower()})"
        for n, o in enumerate(every)
    )
    tokens = ", ".join(
        f"({n}, {i}, '{w}', {int(i in o.mandatory)})" for n, o in enumerate(every) for i, w in enumerate(o.tokens)
    )
    return f"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS_SQL} AS l FROM documents),
  notices(n, label, size, needed, keys, is_base) AS (VALUES {heads}),
  tokens(n, i, word, is_key) AS (VALUES {tokens}),
  places AS (SELECT id, unnest(l) AS word, unnest(range(len(l))) AS p FROM w),
  starts AS (SELECT id, n, p - i AS start, count(*) AS same, sum(is_key) AS keys_same
    FROM places JOIN tokens USING (word) GROUP BY ALL),
  found AS (SELECT id, label, start, same / CAST(size AS DOUBLE) AS share, is_base
    FROM starts JOIN notices USING (n) WHERE same >= needed AND keys_same = keys),
  sums AS (SELECT id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word,
      max(start) FILTER (is_base) AS last_word, max(share) AS score,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY id)
SELECT doc_id, len(l) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN sums USING (id)"""


def _damaged(turns: DataFrame) -> DataFrame:
    """Turns after the damage that the contract names, by CRC-32 of ``conv_id:turn``."""
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    damage = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(filled("text"), "[.!?]", ""))
    copies = F.when(damage == 0, 0).when(damage == 3, 2).otherwise(1)
    return turns.select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(filled("role")).alias("role"),
        text.otherwise(filled("text")).alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    from burstlens.llm.conversations import repair_conversations, repaired_digests
    from burstlens.llm.places import written

    original = spark.read.parquet(f"{d}/conversations.parquet")
    turns = _damaged(original)
    report = written(repair_conversations(turns), "repair")
    digests = repaired_digests(turns, report)
    ids = original.select(F.col("conv_id").alias("id")).distinct()
    found = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


_REPAIR_SQL = r"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
  raw AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS h
    FROM conversations c JOIN ids ON ids.conv_id IS NOT DISTINCT FROM c.conv_id),
  damaged AS (SELECT g, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
      CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM raw, (VALUES (1), (2)) AS copies(copy) WHERE copy <= CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i,
      row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST) AS seen,
      CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
      rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inner_text FROM damaged),
  turns AS (SELECT *, CASE WHEN inner_text = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN right(inner_text, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      initial || lead(initial) OVER (PARTITION BY g ORDER BY i) AS pair FROM ranked),
  -- Roles so far: 0 none, 1 system, 2 user, 3 assistant last. Inserts before a turn, then its edit.
  inserts(state, letters, cost, after) AS (VALUES (0, '', 0, 0), (0, 'I', 5, 2), (0, 'II', 10, 3), (1, '', 0, 1),
      (1, 'I', 5, 2), (1, 'II', 10, 3), (2, '', 0, 2), (2, 'I', 5, 3), (3, '', 0, 3), (3, 'I', 5, 2)),
  edits(state, initial, letter, cost, after) AS (VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2),
      (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2), (0, '', 'R', 1, 2), (1, '', 'R', 1, 2), (2, '', 'R', 1, 3),
      (3, '', 'R', 1, 2), (0, '', 'D', 2, 0), (1, '', 'D', 2, 1), (2, '', 'D', 2, 2), (3, '', 'D', 2, 3)),
  ways AS (SELECT g, 0 AS i, 0 AS state, repeat('0', 12) AS way FROM ids
    UNION ALL
    SELECT w.g, w.i + 1, e.after, min(lpad(CAST(CAST(way[:12] AS BIGINT) + n.cost + e.cost
        + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END AS VARCHAR), 12, '0')
        || way[13:] || n.letters || letter)
    FROM ways w JOIN turns t ON t.g = w.g AND t.i = w.i JOIN inserts n ON n.state = w.state
      JOIN edits e ON e.state = n.after AND (e.initial = '' OR e.initial = t.initial)
        AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
    GROUP BY w.g, w.i, e.after),
  stats AS (SELECT g, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY g),
  best AS (SELECT w.g, min(lpad(CAST(CAST(way[:12] AS BIGINT) + n.cost AS VARCHAR), 12, '0') || way[13:] || n.letters)
      AS way FROM ways w JOIN stats s ON s.g = w.g AND s.n = w.i JOIN inserts n ON n.state = w.state
    WHERE n.after IN (0, 3) GROUP BY w.g),
  letters AS (SELECT g, p, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY g ORDER BY p) - 1 AS i
    FROM (SELECT g, unnest(string_split(way[13:], '')) AS letter, generate_subscripts(string_split(way[13:], ''), 1) AS p
      FROM best WHERE length(way) > 12)),
  kept AS (SELECT l.g, p, letter, t.role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text, t.initial,
      row_number() OVER (PARTITION BY l.g ORDER BY p) - 1 AS o
    FROM letters l LEFT JOIN turns t ON t.g = l.g AND t.i = l.i WHERE letter <> 'D'),
  roles AS (SELECT *, max(CASE WHEN o = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END)
      OVER (PARTITION BY g) AS system FROM kept),
  results AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o + system) % 2 = 0 THEN 'user'
      ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired FROM roles GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(way[:12] AS BIGINT), 0) AS cost, coalesce(way[13:], '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids LEFT JOIN stats USING (g) LEFT JOIN best USING (g) LEFT JOIN results USING (g)"""


def _repair_sql() -> str:
    key = "coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return _REPAIR_SQL.replace("{crc}", _crc_sql(key))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_decontamination": op3_decontamination,
        "op4_warc": op4_warc,
        "op5_token_files": op5_token_files,
        "op6_quality_rules": op6_quality_rules,
        "op7_simhash_duplicates": op7_simhash_duplicates,
        "op8_bpe_roundtrip": op8_bpe_roundtrip,
        "op9_token_counts": op9_token_counts,
        "op10_toxicity": op10_toxicity,
        "op11_license_scan": op11_license_scan,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": _SHARDS_SQL,
        "op3_decontamination": _CONTAMINATION_SQL,
        "op4_warc": _WARC_SQL,
        "op11_license_scan": _licenses_sql(),
        "op12_conversation_repair": _repair_sql(),
        "op13_merkle": _merkle_sql(),
    }
