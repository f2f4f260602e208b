"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat_format import CONTROLS, OTHER, TEMPLATE

OP1 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""

OP10 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS winner
  FROM pages
)
SELECT page_id,
       octet_length(encode(body))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM p
"""



def _h(*parts: str) -> str:
    """60 bits of the MD5 of SQL texts joined by ``|``."""
    return f"('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15))::BIGINT"


_ID = "coalesce(doc_id::VARCHAR, 'null')"
OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         {_h("'17'", "'block'", _ID)} AS deal
  FROM documents
), t AS (
  SELECT skey, sum(tokens)::BIGINT AS total FROM d GROUP BY skey
), s AS (
  SELECT skey, total, total / (SELECT sum(total)::DOUBLE FROM t) AS p FROM t WHERE total > 0
), e AS (
  SELECT k, ln(sum(pow(p, a))) - max(a) * sum(pow(p, a) * ln(p)) / sum(pow(p, a)) >= 0.98::DOUBLE * ln(count(*)::DOUBLE) AS ok
  FROM (SELECT k, k::DOUBLE / 10000::DOUBLE AS a FROM range(0, 10001) r(k)), s GROUP BY k
), x AS (
  SELECT coalesce(max(k), 0)::DOUBLE / 10000::DOUBLE AS a FROM e WHERE ok
), w AS (
  SELECT skey, total, pow(p, a) / sum(pow(p, a)) OVER () AS q FROM s, x
), goals AS (
  SELECT skey, round(max(total / q) OVER () * q)::BIGINT AS goal FROM w
), plan AS (
  SELECT skey, total, greatest(1, ceil(total / 4000000::DOUBLE))::BIGINT AS n_blocks,
         CASE WHEN total = 0 THEN 1 ELSE goal // total END AS epochs,
         CASE WHEN total = 0 THEN 0 ELSE goal % total END AS rest
  FROM t LEFT JOIN goals USING (skey)
), dealt AS (
  SELECT d.*, deal % n_blocks AS block, epochs, rest FROM d JOIN plan USING (skey)
), b AS (
  SELECT skey, block, sum(tokens)::BIGINT AS b_tokens, max(epochs) AS epochs, max(rest) AS rest FROM dealt GROUP BY ALL
), rooms AS (
  SELECT skey, block, b_tokens, greatest(0, rest - coalesce(sum(b_tokens) OVER (
           PARTITION BY skey ORDER BY {_h("'17'", "'pass'", "epochs::VARCHAR", "skey", "block::VARCHAR")}, block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room
  FROM b
), cuts AS (
  SELECT skey, block, max(o) AS cut FROM (
    SELECT skey, block, o, room, coalesce(sum(tokens) OVER (PARTITION BY skey, block ORDER BY o, tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT dealt.*, room, {_h("'17'", "'doc'", "epochs::VARCHAR", _ID)} AS o
          FROM dealt JOIN rooms USING (skey, block) WHERE room > 0 AND room < b_tokens)
  ) WHERE before < room GROUP BY ALL
), visits AS (
  SELECT dealt.*, room, b_tokens, cut, unnest(range(0, epochs + 1)) AS epoch
  FROM dealt JOIN rooms USING (skey, block) LEFT JOIN cuts USING (skey, block)
), placed AS (
  SELECT *, {_h("'17'", "'doc'", "epoch::VARCHAR", _ID)} AS o FROM visits
)
SELECT doc_id, source, epoch::INT AS mix_epoch,
       {_h("'17'", "'pass'", "epoch::VARCHAR", "skey", "block::VARCHAR")} AS mix_block, o AS mix_order
FROM placed
WHERE epoch < epochs OR (room > 0 AND (room >= b_tokens OR o <= cut))
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\s')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\c{c[1:]}')"
    return out


_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in TEMPLATE.items())
_TOKEN = "</s>[INST] ok [/INST]"
OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_TOKEN}'), (-7, 1, 'assistant', '{_TOKEN}')
), per AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length({_escaped('text')}) + CASE role {_MARKS}
             ELSE {len(OTHER[0]) + len(OTHER[1]) + 1} + length({_escaped('role')}) END)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM per
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 byte by byte; its table follows from the polynomial.
OP12 = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents
), per AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(tagged))),
           lambda i: ('0x' || substr(hex(encode(tagged)), 2 * i + 1, 2))::BIGINT),
           lambda r, b: xor(r >> 8, t[1 + (xor(r, b) & 255)]), 4294967295)) AS h
  FROM per, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(c) >= 2 AND length(word) >= 7
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS left_out
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, left_out) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON b.word = a.left_out
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON b.word = a.left_out
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
  FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL SELECT p.word, f.form, step + 1 FROM path p JOIN forms f ON f.word = p.place WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(place, step) AS root FROM path GROUP BY word) USING (word)
"""

ORACLE_SQL = {
    "op1_exact_dedup": OP1,
    "op3_mixing": OP3,
    "op5_chat_format": OP5,
    "op10_warc": OP10,
    "op12_spelling_variants": OP12,
}
