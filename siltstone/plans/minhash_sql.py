"""SQL for MinHash signatures and what follows from them, for engines without wrapping arithmetic.

64-bit products are put together from 32-bit halves. ``signatures`` gives CTEs up to
``sig(doc_id, k, v)``: word k (from 1) of a document's signature.
"""

from __future__ import annotations

from siltstone.functions import text, u64
from siltstone.functions.text import BANDS, MATCH_JACCARD, ROWS, SIGNATURE_WORDS

LOW = (1 << 32) - 1


def product(z: str, factor: int) -> str:
    """z * factor modulo 2^64 for an unsigned column ``z``."""
    al, ah, bl, bh = f"({z} & {LOW})", f"({z} >> 32)", factor & LOW, factor >> 32
    low = f"({al} * {bl}::UBIGINT)"
    high = f"((({low} >> 32) + (({ah} * {bl}::UBIGINT) & {LOW}) + (({al} * {bh}::UBIGINT) & {LOW})) & {LOW})"
    return f"({high} * 4294967296::UBIGINT + ({low} & {LOW}))"


def signatures(shingles: str, seeds) -> str:
    """``shingles``: CTEs up to s(doc_id, x), the shingles of each document as hex digits; x null for a document without any."""
    listed = "[" + ", ".join(str(int(x)) for x in seeds) + "]::UBIGINT[]"
    step = f"xor(a, b) * {u64.FNV_PRIME}::UHUGEINT % 18446744073709551616::UHUGEINT"
    return f"""{shingles},
u AS (SELECT DISTINCT x FROM s WHERE x IS NOT NULL),
f AS (SELECT x, list_reduce(list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::UHUGEINT), lambda a, b: {step}, {u64.FNV_OFFSET}::UHUGEINT)::UBIGINT AS h FROM u),
seeds AS (SELECT unnest(range(1, {len(seeds) + 1})) AS k, unnest({listed}) AS seed),
m0 AS (SELECT x, k, xor(h, seed) AS z FROM f, seeds),
m1 AS (SELECT x, k, xor(z, z >> 30) AS z FROM m0),
m2 AS (SELECT x, k, {product("z", u64.MIX_A)} AS z FROM m1),
m3 AS (SELECT x, k, xor(z, z >> 27) AS z FROM m2),
m4 AS (SELECT x, k, {product("z", u64.MIX_B)} AS z FROM m3),
sig AS (
  SELECT doc_id, k, min(xor(z, z >> 31)) AS v FROM s JOIN m4 USING (x) GROUP BY doc_id, k
  UNION ALL SELECT doc_id, k, 18446744073709551615::UBIGINT FROM s, seeds WHERE x IS NULL
)"""


def of_texts(words: str) -> str:
    """``words``: an expression for the words of a row of documents."""
    k = f"least({text.SHINGLE_WORDS}, len(w))"
    return signatures(
        f"""WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, hex(encode(array_to_string(w[i:i + {k} - 1], ' '))) AS x FROM w, unnest(range(1, len(w) - {k} + 2)) AS t(i) WHERE len(w) > 0
  UNION ALL SELECT doc_id, NULL FROM w WHERE len(w) = 0
)""",
        text.SEEDS,
    )


def digits(column: str = "v") -> str:
    return f"string_agg(lpad(lower(to_hex({column})), 16, '0'), ' ' ORDER BY k)"


def near_duplicates(words: str, canon: str) -> str:
    return f"""{_classes(words, canon)}
SELECT a, b, jaccard, false AS copy FROM pairs
UNION ALL SELECT rep, doc_id, 1.0::DOUBLE, true FROM members JOIN reps USING (tier1) WHERE doc_id <> rep"""


def _classes(words: str, canon: str) -> str:
    return f"""{of_texts(words)},
members AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256({canon}) END AS tier1 FROM documents),
reps AS (SELECT tier1, min(doc_id) AS rep FROM members WHERE tier1 IS NOT NULL GROUP BY tier1),
own AS (SELECT * FROM sig WHERE doc_id IN (SELECT rep FROM reps)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) / {SIGNATURE_WORDS}.0::DOUBLE AS jaccard FROM own a JOIN own b ON a.k = b.k AND a.v = b.v AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING count(*) / {SIGNATURE_WORDS}.0::DOUBLE >= {MATCH_JACCARD}
)"""


def clusters(words: str, canon: str) -> str:
    return f"""{_classes(words, canon)},
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT tier1, min(b) AS cluster_id FROM reps JOIN reach ON rep = a GROUP BY tier1),
rows AS (SELECT doc_id, tier1, cluster_id FROM members LEFT JOIN named USING (tier1)),
sizes AS (SELECT cluster_id, count(*) AS n, count(DISTINCT tier1) AS kinds FROM rows WHERE cluster_id IS NOT NULL GROUP BY cluster_id),
dedup AS (
  SELECT doc_id, cluster_id, CASE WHEN cluster_id IS NULL THEN 'skipped' WHEN n > 1 THEN 'grouped' ELSE 'single' END AS status, coalesce(n > 1 AND kinds = 1, false) AS exact
  FROM rows LEFT JOIN sizes USING (cluster_id)
)"""


def report(words: str, canon: str) -> str:
    return f"""{clusters(words, canon)}
SELECT cluster_id, '{{"exact":' || max(exact)::VARCHAR || ',"members":[' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) || ']}}' AS report
FROM dedup WHERE status = 'grouped' GROUP BY cluster_id"""


def lookup(words: str) -> str:
    return f"""{of_texts(words)},
keys AS (SELECT doc_id, (k - 1) // {ROWS} AS band, {digits()} AS key FROM sig GROUP BY doc_id, band HAVING band < {BANDS})
SELECT DISTINCT q.doc_id AS query_id, i.doc_id AS id FROM keys q JOIN keys i USING (band, key) WHERE q.doc_id % 50 = 0"""


def checksums() -> str:
    """CRC-32 (reflected, its table from the polynomial), Adler-32 and FNV-1a of the texts' bytes."""
    def entry(i: int) -> int:
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        return i

    table = "([" + ", ".join(str(entry(i)) for i in range(256)) + "]::BIGINT[])"
    return f"""
WITH x AS (SELECT doc_id, text, hex(encode(text)) AS x FROM documents),
y AS (SELECT doc_id, text, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT) AS b FROM x)
SELECT doc_id,
       xor(list_reduce(b, lambda c, d: xor(c >> 8, {table}[1 + (xor(c, d) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc32,
       (((len(b) + list_sum(list_transform(b, lambda v, i: (len(b) - i + 1) * v))) % 65521) * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS adler32,
       lpad(lower(to_hex(list_reduce(list_transform(b, lambda v: v::UHUGEINT), lambda a, v: xor(a, v) * {u64.FNV_PRIME}::UHUGEINT % 18446744073709551616::UHUGEINT, {u64.FNV_OFFSET}::UHUGEINT)::UBIGINT)), 16, '0') AS fnv1a64
FROM y"""
