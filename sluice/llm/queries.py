"""The registered queries of the llm operators: each applies its operator to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import shared_folder, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.quality_classifier import classified

    return classified(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.html_extraction import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.substring_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.pii import found

    return found(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.licenses import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.conversations import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluice.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), most=5, least=100, percent=100, first=2000)


QUERIES = {
    "op4_html_extraction": op4_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op6_pii": op6_pii,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op9_warc": op9_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op11_license_scan": op11_license_scan,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op9_warc": """
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id
  FROM (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
""",
    "op12_phrase_collocations": r"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM pieces, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(ws) >= k) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
common AS (SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE f >= 100),
cuts AS (SELECT c.lang, c.phrase, c.ws, c.k, c.f AS a, x.f AS l, y.f AS r, t.n, j, ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM common WHERE k > 1) c
  JOIN totals t ON t.lang = c.lang
  JOIN common x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN common y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
free AS (SELECT * FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM common c
  WHERE c.lang = w.lang AND c.k > w.k AND c.f >= w.a AND contains(' ' || c.phrase || ' ', ' ' || w.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM free
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
    "op13_conversation_repair": """
WITH RECURSIVE source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS k FROM conversations),
damaged AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) FROM source)),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS copy FROM (SELECT *, row_number() OVER o AS i, lag(left(role, 1)) OVER o AS before, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS sign
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))),
faulty AS (SELECT *, CASE WHEN sign = '' THEN 'blank' WHEN copy THEN 'duplicate' WHEN sign NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
steps AS (SELECT conv_id, i, initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty),
ids AS (SELECT DISTINCT conv_id FROM conversations),
-- the cheapest edits that reach each state (nothing yet, system, user, assistant), as eight digits of cost and then the edits; inserts follow a row
paths AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS e, '99999999' AS s, '00000003I' AS u, '00000006II' AS a FROM ids
  UNION ALL
  SELECT conv_id, i, e, s, least(u0, CASE WHEN least(e, s, a0) < '9' THEN printf('%08d', left(least(e, s, a0), 8)::BIGINT + 3) || substr(least(e, s, a0), 9) || 'I' ELSE u0 END),
    least(a0, CASE WHEN least(u0, CASE WHEN least(e, s, a0) < '9' THEN printf('%08d', left(least(e, s, a0), 8)::BIGINT + 3) || substr(least(e, s, a0), 9) || 'I' ELSE u0 END) < '9'
      THEN printf('%08d', left(least(u0, CASE WHEN least(e, s, a0) < '9' THEN printf('%08d', left(least(e, s, a0), 8)::BIGINT + 3) || substr(least(e, s, a0), 9) || 'I' ELSE u0 END), 8)::BIGINT + 3)
        || substr(least(u0, CASE WHEN least(e, s, a0) < '9' THEN printf('%08d', left(least(e, s, a0), 8)::BIGINT + 3) || substr(least(e, s, a0), 9) || 'I' ELSE u0 END), 9) || 'I' ELSE a0 END)
  FROM (SELECT p.conv_id, r.i,
      printf('%08d', left(p.e, 8)::BIGINT + 4) || substr(p.e, 9) || 'D' AS e,
      least(CASE WHEN p.s < '9' THEN printf('%08d', left(p.s, 8)::BIGINT + 4) || substr(p.s, 9) || 'D' ELSE '99999999' END,
        CASE WHEN NOT gone AND initial = 's' THEN printf('%08d', left(p.e, 8)::BIGINT + cut) || substr(p.e, 9) || 'K' ELSE '99999999' END) AS s,
      least(printf('%08d', left(p.u, 8)::BIGINT + 4) || substr(p.u, 9) || 'D',
        CASE WHEN NOT gone THEN printf('%08d', left(least(p.e, p.s, p.a), 8)::BIGINT + cut + CASE WHEN initial = 'u' THEN 0 ELSE 3 END) || substr(least(p.e, p.s, p.a), 9) || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END ELSE '99999999' END) AS u0,
      least(printf('%08d', left(p.a, 8)::BIGINT + 4) || substr(p.a, 9) || 'D',
        CASE WHEN NOT gone THEN printf('%08d', left(p.u, 8)::BIGINT + cut + CASE WHEN initial = 'a' THEN 0 ELSE 3 END) || substr(p.u, 9) || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END ELSE '99999999' END) AS a0
    FROM paths p JOIN steps r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)),
counts AS (SELECT ids.conv_id, coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(f.i) AS n
  FROM ids LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
best AS (SELECT c.*, left(least(e, a), 8)::BIGINT AS cost, substr(least(e, a), 9) AS audit FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n),
edits AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, j - length(replace(substr(audit, 1, j), 'I', '')) AS inserted FROM (SELECT conv_id, audit, unnest(generate_series(1, length(audit))) AS j FROM best)),
rows AS (SELECT x.conv_id, j, edit, f.role, f.text, f.initial FROM edits x LEFT JOIN faulty f ON x.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.j - x.inserted WHERE edit <> 'D'),
placed AS (SELECT *, row_number() OVER w - max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS body FROM placed GROUP BY conv_id)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM best b LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
""",
}
