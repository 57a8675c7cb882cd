"""The registered queries as SQL over the given tables.

Written from the meaning of each operation, not from the Spark code: a query is
a final SELECT and the common table expressions it needs. Random decisions are
the same XXH64 and MD5 hashes, spelled out in 128-bit arithmetic.
"""

import re

from tokenmill.functions import draws
from tokenmill.plans.inputs import BATCH_SIZE, K, MAX_LENGTH, N_WORDS, SEED

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                      0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
#: the seed Spark's xxhash64 starts from
START = 42
LOW = "18446744073709551615::UHUGEINT"

# The code points that are white space at the ends of a line.
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
STRIP_SET = "concat(" + ",".join(f"chr({c})" for c in SPACES) + ")"
#: an overflow segment's number is that of its text times this, plus its window's
WINDOWS = 67108864
#: 32-bit draws below these are the shares 0.15, 0.8 and 0.9
BELOW_15, BELOW_80, BELOW_90 = 644245094, 3435973836, 3865470566
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"


def _mul(a, b):
    return f"(({a}) * {b}::UHUGEINT & {LOW})"


def _add(a, b):
    return f"(({a}) + ({b}) & {LOW})"


def _rotl(x, r):
    return f"({_mul(x, 1 << r)} | ({x} >> {64 - r}))"


def xxh64(source: str, parts: list[str], name: str = "hash") -> str:
    """SELECT * plus XXH64 of 64-bit integers, each one the seed of the next."""
    sql, seed = f"SELECT * FROM {source}", f"{START}::UHUGEINT"
    for n, part in enumerate(parts):
        k, h = f"_k{n}", f"_h{n}"
        sql = f"SELECT *, {_mul(f'({part})::UHUGEINT', P2)} AS {k} FROM ({sql})"
        sql = (f"SELECT *, xor({_add(seed, f'{P5 + 8}::UHUGEINT')}, {_mul(_rotl(k, 31), P1)}) AS {h}a FROM ({sql})")
        sql = f"SELECT *, {_add(_mul(_rotl(f'{h}a', 27), P1), f'{P4}::UHUGEINT')} AS {h}b FROM ({sql})"
        sql = f"SELECT *, {_mul(f'xor({h}b, {h}b >> 33)', P2)} AS {h}c FROM ({sql})"
        sql = f"SELECT *, {_mul(f'xor({h}c, {h}c >> 29)', P3)} AS {h}d FROM ({sql})"
        sql = f"SELECT * EXCLUDE ({k}, {h}a, {h}b, {h}c, {h}d), xor({h}d, {h}d >> 32) AS {h} FROM ({sql})"
        seed = h
    chain = ", ".join(f"_h{n}" for n in range(len(parts)))
    return f"SELECT * EXCLUDE ({chain}), {seed} AS {name} FROM ({sql})"


def row_key(*names: str) -> str:
    text = " || '|' || ".join([f"'{SEED}'", *names])
    return f"('0x' || substr(md5({text}), 1, 15))::UBIGINT"


ORDER_DRAW = "(hash >> 1)"
DRAW = "((hash >> 32)::BIGINT)"

CTE: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTE[name] = sql


# files, lines, sentences

cte("files", "SELECT doc_id::VARCHAR AS file_key, text FROM documents")
cte("turns", "SELECT 'turn-' || conv_id || '-' || turn AS file_key, text FROM conversations")


def physical_lines(files: str) -> str:
    return f"""
SELECT file_key, ord - 1 AS row_no, line FROM (
  SELECT file_key, unnest(parts) AS line, generate_subscripts(parts, 1) AS ord, len(parts) AS n
  FROM (SELECT file_key, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM {files}))
WHERE NOT (ord = n AND line = '')"""


cte("raw", physical_lines("files"))
cte("raw_turns", physical_lines("turns"))
cte("raw_pages", physical_lines("(SELECT page_id::VARCHAR AS file_key, html AS text FROM pages)"))
cte("lines", f"""
SELECT file_key, row_number() OVER (PARTITION BY file_key ORDER BY row_no) - 1 AS line_no, line
FROM (SELECT file_key, row_no, trim(line, {STRIP_SET}) AS line FROM raw) WHERE line <> ''""")
cte("joined", """
SELECT f.file_key, coalesce(string_agg(line, ' ' ORDER BY line_no), '') AS text
FROM files f LEFT JOIN lines l ON f.file_key = l.file_key GROUP BY ALL""")
cte("sentences", """
SELECT file_key, ord - 1 AS text_no, piece || '.' AS text FROM (
  SELECT file_key, unnest(parts) AS piece, generate_subscripts(parts, 1) AS ord
  FROM (SELECT file_key, string_split(text, '.') AS parts FROM joined))""")


def sentence_groups(n: int) -> str:
    return f"""
SELECT file_key, text_no // {n} AS text_no, string_agg(text, ' ' ORDER BY text_no) AS text
FROM sentences GROUP BY file_key, text_no // {n}"""


cte("threes", sentence_groups(3))
cte("twos", sentence_groups(2))

# vocabulary

WORDS = f"regexp_extract_all(lower(strip_accents(%s)), '[{PUNCTUATION}]|[^\\s{PUNCTUATION}]+')"

cte("counted", f"""
SELECT word, count(*) AS n FROM (SELECT unnest({WORDS % 'text'}) AS word FROM files) GROUP BY word""")
cte("letters", "SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM counted")
cte("vocab", f"""
SELECT token, row_number() OVER (ORDER BY part, ord, token) - 1 AS token_id FROM (
  SELECT 0 AS part, unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']) AS token,
         unnest(range(5)) AS ord
  UNION ALL SELECT 1, ch, 0 FROM letters WHERE ch <> ''
  UNION ALL SELECT 2, '##' || ch, 0 FROM letters WHERE ch <> ''
  UNION ALL (SELECT 3, word, -n FROM counted WHERE length(word) > 1 ORDER BY n DESC, word LIMIT {N_WORDS}))""")


def encoding(name: str, texts: str) -> None:
    """CTE ``<name>(file_key, text_no, pieces)`` for texts(file_key, text_no, text)."""
    cte(f"{name}_words", f"""
SELECT file_key, text_no, unnest(words) AS word, generate_subscripts(words, 1) AS ord
FROM (SELECT file_key, text_no, {WORDS % 'text'} AS words FROM {texts})""")
    cte(f"{name}_distinct", f"SELECT DISTINCT word FROM {name}_words")
    cte(f"{name}_longest", f"""
SELECT s.word, s.b, max(s.e) AS e, max_by(v.token_id, s.e) AS token_id
FROM (SELECT word, b, unnest(range(b + 1, length(word) + 1)) AS e
      FROM (SELECT word, unnest(range(length(word))) AS b FROM {name}_distinct WHERE length(word) <= 100)) s
JOIN vocab v ON v.token_id >= 5 AND v.token = CASE WHEN s.b > 0 THEN '##' ELSE '' END || substr(s.word, s.b + 1, s.e - s.b)
GROUP BY s.word, s.b""")
    cte(f"{name}_walk", f"""
SELECT word, 0::BIGINT AS at, []::BIGINT[] AS ids FROM {name}_distinct
UNION ALL
SELECT w.word, l.e, list_append(w.ids, l.token_id) FROM {name}_walk w JOIN {name}_longest l ON l.word = w.word AND l.b = w.at""")
    cte(f"{name}_ids", f"""
SELECT d.word, coalesce(w.ids, [1]) AS ids FROM {name}_distinct d
LEFT JOIN {name}_walk w ON w.word = d.word AND w.at = length(d.word)""")
    cte(name, f"""
SELECT t.file_key, t.text_no, coalesce(p.pieces, []) AS pieces FROM {texts} t LEFT JOIN (
  SELECT file_key, text_no, flatten(list(i.ids ORDER BY w.ord)) AS pieces
  FROM {name}_words w JOIN {name}_ids i ON i.word = w.word GROUP BY file_key, text_no) p
ON p.file_key = t.file_key AND p.text_no = t.text_no""")


cte("line_texts", "SELECT file_key, line_no AS text_no, line AS text FROM lines")
cte("turn_texts", "SELECT file_key, row_no AS text_no, line AS text FROM raw_turns")
encoding("pieces", "line_texts")
encoding("two_pieces", "twos")
encoding("turn_pieces", "turn_texts")


def first_window(pieces: str, max_length: int) -> str:
    return f"""
SELECT file_key, text_no AS seg_id, [2] || pieces[1:{max_length - 2}] || [3] AS ids FROM {pieces}"""


def all_windows(pieces: str, max_length: int) -> str:
    room = max_length - 2
    return f"""
SELECT file_key, text_no * {WINDOWS} + chunk AS seg_id,
       [2] || pieces[chunk * {room} + 1 : chunk * {room} + {room}] || [3] AS ids
FROM (SELECT *, unnest(range(greatest((len(pieces) + {room - 1}) // {room}, 1))) AS chunk FROM {pieces})"""


cte("segs", first_window("pieces", MAX_LENGTH))
cte("segs_512", all_windows("pieces", 512))
cte("segs_sentences", all_windows("two_pieces", MAX_LENGTH))
cte("segs_turns", "SELECT file_key, text_no AS seg_id, [2] || pieces || [3] AS ids FROM turn_pieces")
cte("segs_overflow", all_windows("pieces", MAX_LENGTH))

cte("own_pieces", """
SELECT file_key, text_no, list_transform(string_split(text, ' '), lambda w: 5 + least(length(w), 99)) AS pieces
FROM line_texts""")
cte("segs_own", all_windows("own_pieces", MAX_LENGTH))

# pairs


def pairing(name: str, segs: str) -> None:
    cte(f"{name}_placed", xxh64(f"(SELECT *, {row_key('file_key')} AS k FROM {segs})",
                                ["k", str(draws.PAIRING), "seg_id"]))
    cte(f"{name}_ranked", f"""
SELECT file_key, seg_id, ids, row_number() OVER (PARTITION BY file_key ORDER BY {ORDER_DRAW}, seg_id) - 1 AS r
FROM {name}_placed""")
    cte(name, f"""
SELECT a.file_key, a.r // 2 AS example_id, a.seg_id AS seg_a_id, b.seg_id AS seg_b_id,
       len(a.ids) AS size_a, len(b.ids) - 1 AS size_b, a.ids || b.ids[2:] AS ids
FROM {name}_ranked a JOIN {name}_ranked b ON a.file_key = b.file_key AND b.r = a.r + 1 AND a.r % 2 = 0""")


pairing("pairs", "segs")
pairing("pairs_overflow", "segs_overflow")


def repeat(value: str, n: str) -> str:
    return f"list_resize([]::BIGINT[], ({n})::BIGINT, {value}::BIGINT)"


def frame(n: str) -> str:
    return f"([1] || {repeat('0', f'{n} - 2')} || [1])"


def framed_pairs(pairs: str) -> str:
    return f"""
SELECT file_key, example_id, seg_a_id, seg_b_id, ids, {repeat('1', 'size_a + size_b')} AS attention_mask,
       {frame('size_a')} || ({frame('(size_b + 1)')})[2:] AS special_tokens_mask,
       {repeat('0', 'size_a')} || {repeat('1', 'size_b')} AS token_type_ids, size_a + size_b AS n_tokens
FROM {pairs}"""


cte("examples", framed_pairs("pairs_overflow"))
cte("cut_examples", framed_pairs("pairs"))


def singles(segs: str) -> str:
    return f"""
SELECT file_key, seg_id AS example_id, seg_id AS seg_a_id, NULL::BIGINT AS seg_b_id, ids,
       {repeat('1', 'len(ids)')} AS attention_mask, {frame('len(ids)')} AS special_tokens_mask,
       {repeat('0', 'len(ids)')} AS token_type_ids, len(ids) AS n_tokens
FROM {segs}"""


cte("single", singles("segs_overflow"))
cte("single_turns", singles("segs_turns"))


def text(expression: str, name: str) -> str:
    return f"array_to_string({expression}, ',') AS {name}"


ARRAYS = ("ids", "attention_mask", "special_tokens_mask", "token_type_ids")
EXPORT = ", ".join(["file_key", "example_id", "seg_a_id", "seg_b_id",
                    *(text(a, a) for a in ARRAYS), "n_tokens::INTEGER AS n_tokens"])

# order, split, batches

cte("example_keys", f"SELECT file_key, example_id, n_tokens, {row_key('file_key')} AS k FROM examples")


def file_order(name: str, rows: str) -> None:
    cte(f"{name}_placed", xxh64(f"(SELECT file_key, example_id, {row_key('file_key')} AS k FROM {rows})",
                                ["k", str(draws.FILE_ORDER)]))
    cte(name, f"""
SELECT file_key, example_id, row_number() OVER (ORDER BY {ORDER_DRAW}, file_key, example_id) - 1 AS global_idx
FROM {name}_placed""")


file_order("in_order", "examples")
file_order("turns_in_order", "single_turns")


def shuffle(name: str, epoch: int) -> None:
    cte(f"{name}_placed", xxh64("example_keys", ["k", str(draws.SHUFFLE), str(epoch), "example_id"]))
    cte(name, f"""
SELECT file_key, example_id, idx // {BATCH_SIZE} AS batch_id, (idx % {BATCH_SIZE})::INTEGER AS row_in_batch
FROM (SELECT file_key, example_id,
             row_number() OVER (ORDER BY {ORDER_DRAW}, file_key, example_id) - 1 AS idx FROM {name}_placed)""")


shuffle("shuffled", 0)
shuffle("shuffled_again", 1)

cte("split_placed", xxh64(f"(SELECT file_key, {row_key('file_key')} AS k FROM files)", ["k", str(draws.SPLIT)]))
cte("split_ranked", f"""
SELECT file_key, row_number() OVER (ORDER BY {ORDER_DRAW}, file_key) - 1 AS r, count(*) OVER () AS n
FROM split_placed""")
# the split of the cache counts only files that have examples
cte("cache_split_placed", xxh64(f"(SELECT DISTINCT file_key, {row_key('file_key')} AS k FROM examples)",
                                ["k", str(draws.SPLIT)]))
cte("cache_split_ranked", f"""
SELECT file_key, row_number() OVER (ORDER BY {ORDER_DRAW}, file_key) - 1 AS r, count(*) OVER () AS n
FROM cache_split_placed""")


def split_case(train: float, val: float, test: float | None = None) -> str:
    ends = [f"floor(n * {train}::DOUBLE)", f"floor(n * {val}::DOUBLE)"]
    last = f"WHEN r < {ends[0]} + {ends[1]} + floor(n * {test}::DOUBLE) THEN 'test'" if test else "ELSE 'test'"
    return f"CASE WHEN r < {ends[0]} THEN 'train' WHEN r < {ends[0]} + {ends[1]} THEN 'val' {last} END AS split"


def padding(width: str) -> str:
    def fill(name, value):
        return text(f"list_resize({name}, {width}, {value}::BIGINT)", name)
    return ", ".join([fill("ids", 0), fill("attention_mask", 0), fill("special_tokens_mask", 1),
                      fill("token_type_ids", 1)])


# masking


def masking(name: str, rows: str, epoch: int = 0) -> None:
    """CTE ``<name>(file_key, example_id, pos, id, special, selected, fate, word)``."""
    cte(f"{name}_keys", xxh64(f"(SELECT file_key, example_id, ids, special_tokens_mask, {row_key('file_key')} AS k FROM {rows})",
                              ["k", str(draws.MASK), str(epoch), "example_id"], "mask_key"))
    cte(f"{name}_positions", f"""
SELECT file_key, example_id, mask_key, unnest(ids) AS id, unnest(special_tokens_mask) AS special,
       unnest(range(len(ids))) AS pos FROM {name}_keys""")
    select = xxh64(f"{name}_positions", ["mask_key", "pos * 4"])
    cte(f"{name}_selected", f"""
SELECT * EXCLUDE (hash), special = 0 AND id <> 0 AND {DRAW} < {BELOW_15} AS selected FROM ({select})""")
    fate = xxh64(f"{name}_selected", ["mask_key", "pos * 4 + 1"], "fate_hash")
    word = xxh64(f"({fate})", ["mask_key", "pos * 4 + 2"], "word_hash")
    cte(name, f"SELECT *, (fate_hash >> 32)::BIGINT AS fate, (word_hash >> 32)::BIGINT AS word FROM ({word})")


masking("mask", "examples")
masking("mask_next", "examples", 1)
masking("mask_turns", "single_turns")

LABEL = "CASE WHEN selected THEN id ELSE -100 END"
MASKED = "CASE WHEN selected THEN 4 ELSE id END"
REPLACED = f"""CASE WHEN NOT selected THEN id WHEN fate < {BELOW_80} THEN 4
  WHEN fate < {BELOW_90} THEN word % (SELECT count(*) FROM vocab) ELSE id END"""


def by_example(rows: str, **columns: str) -> str:
    lists = ", ".join(text(f"list({sql} ORDER BY pos)", name) for name, sql in columns.items())
    return f"SELECT file_key, example_id, {lists} FROM {rows} GROUP BY file_key, example_id"


# scores

cte("score_keys", xxh64(f"(SELECT file_key, example_id, pos, id AS label, {row_key('file_key')} AS k FROM mask WHERE selected)",
                        ["k", str(draws.SCORE), "0", "example_id"], "score_key"))
cte("noisy", f"""
SELECT file_key, example_id, pos, label, k, {DRAW} AS noise
FROM ({xxh64('score_keys', ['score_key', 'pos'])})""")
cte("candidates", f"""
SELECT *, unnest(list_sort([label] || list_filter(
    range(first_word, first_word + {K}), lambda c: c <> label)[1:{K - 1}])) AS cand
FROM (SELECT *, (SELECT count(*) - {N_WORDS} FROM vocab) AS first_word FROM noisy)""")
cte("logits", """
SELECT file_key, example_id, pos, label, k, cand,
       ((((noise + cand * 7919) % 60000)::DOUBLE / 10000.0::DOUBLE
         + CASE WHEN cand = label THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)::FLOAT)::DOUBLE AS logit
FROM candidates""")
cte("shifted", """
SELECT *, exp(logit - max(logit) OVER (PARTITION BY file_key, example_id, pos)) AS e FROM logits""")
cte("weights", f"SELECT *, floor(e * {2.0 ** (62 - K.bit_length())!r}::DOUBLE)::BIGINT AS w FROM shifted")
cte("running", """
SELECT *, sum(w) OVER (PARTITION BY file_key, example_id, pos ORDER BY cand) AS total_here,
       sum(w) OVER (PARTITION BY file_key, example_id, pos) AS total FROM weights""")
cte("sample_keys", xxh64("(SELECT DISTINCT file_key, example_id, k FROM noisy)",
                         ["k", str(draws.SAMPLE), "0", "example_id"], "sample_key"))
cte("picks", f"""
SELECT file_key, example_id, pos, label, {DRAW} AS pick FROM ({xxh64(
    '(SELECT n.file_key, n.example_id, n.pos, n.label, s.sample_key FROM noisy n JOIN sample_keys s USING (file_key, example_id))',
    ['sample_key', 'pos'])})""")
cte("sampled", f"""
SELECT r.file_key, r.example_id, r.pos, any_value(r.label) AS label, min(r.cand) AS token_id
FROM running r JOIN picks p USING (file_key, example_id, pos)
WHERE r.total_here::HUGEINT > (p.pick::HUGEINT * r.total::HUGEINT) // 4294967296
GROUP BY r.file_key, r.example_id, r.pos""")
cte("best", """
SELECT file_key, example_id, pos, any_value(label) AS label, arg_max(cand, (logit, -cand)) AS token_id
FROM logits GROUP BY file_key, example_id, pos""")
cte("corrupted", f"""
SELECT m.file_key, m.example_id, m.pos, CASE WHEN m.selected THEN s.token_id ELSE {MASKED} END AS d_input,
       CASE WHEN m.selected AND s.token_id <> m.id THEN 1 ELSE 0 END AS d_label
FROM mask m LEFT JOIN sampled s USING (file_key, example_id, pos)""")
cte("dense_logits", """
SELECT file_key, example_id, pos, label, cand,
       ((((noise + cand * 7919) % 60000)::DOUBLE / 10000.0::DOUBLE
         + CASE WHEN cand = label THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)::FLOAT)::DOUBLE AS logit
FROM noisy, (SELECT token_id AS cand FROM vocab)""")
cte("dense_mixed", """
SELECT file_key, example_id, pos, cand, logit,
       xor(pick::UBIGINT, (cand::UBIGINT * 2654435761::UBIGINT) & 4294967295::UBIGINT) AS h
FROM dense_logits JOIN picks USING (file_key, example_id, pos)""")
for number, (factor, shift) in enumerate([(2246822507, 13), (3266489909, 16)]):
    source = f"dense_mixed{number or ''}"
    cte(f"dense_mixed{number + 1}", f"""
SELECT * EXCLUDE (h), xor(h, h >> {shift}) AS h FROM (
  SELECT * EXCLUDE (h), (xor(h, h >> 16) * {factor}::UBIGINT) & 4294967295::UBIGINT AS h FROM {source})""")
cte("d_keys", xxh64(f"(SELECT DISTINCT file_key, example_id, {row_key('file_key')} AS k FROM examples)",
                    ["k", str(draws.SCORE), "1", "example_id"], "d_key"))
cte("d_logits", f"""
SELECT file_key, example_id, pos, d_label AS label,
       (((noise // 65536) % 40000)::DOUBLE / 10000.0::DOUBLE)::FLOAT::DOUBLE AS z0,
       ((noise % 40000)::DOUBLE / 10000.0::DOUBLE - 1.0::DOUBLE)::FLOAT::DOUBLE AS z1
FROM (SELECT *, {DRAW} AS noise FROM ({xxh64(
    '(SELECT c.*, d.d_key FROM corrupted c JOIN d_keys d USING (file_key, example_id))', ['d_key', 'pos'])}))""")
cte("g_rows", """
SELECT b.batch_id, l.loss, (t.token_id = t.label)::INTEGER AS hit
FROM best t JOIN shuffled b USING (file_key, example_id) JOIN (
  SELECT file_key, example_id, pos,
         ln(sum(e)) + max(logit) - max(CASE WHEN cand = label THEN logit END) AS loss
  FROM shifted GROUP BY file_key, example_id, pos) l USING (file_key, example_id, pos)""")
cte("d_rows", """
SELECT b.batch_id, ((z1 > z0)::INTEGER = label)::INTEGER AS hit,
       ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) + greatest(z0, z1)
         - CASE WHEN label = 1 THEN z1 ELSE z0 END AS loss
FROM d_logits JOIN shuffled b USING (file_key, example_id)""")
cte("g_batches", "SELECT batch_id, count(*) AS n_active, avg(loss) AS loss, avg(hit) AS accuracy FROM g_rows GROUP BY batch_id")
cte("d_batches", "SELECT batch_id, count(*) AS n_active, avg(loss) AS loss, avg(hit) AS accuracy FROM d_rows GROUP BY batch_id")

# counts

cte("flat", """
SELECT url AS path, replace(regexp_extract(url, '^(.*)/[^/]*$', 1), '/', '') || '-'
       || regexp_extract(url, '([^/]*)$', 1) AS file_key FROM pages""")


def per_file(segs: str) -> str:
    return f"""
SELECT f.file_key, count(s.seg_id) AS num_examples, coalesce(sum(len(s.ids)), 0)::BIGINT AS num_tokens
FROM files f LEFT JOIN {segs} s ON s.file_key = f.file_key GROUP BY f.file_key"""


cte("stats", per_file("segs_overflow"))


def segs_out(segs: str) -> str:
    return f"SELECT file_key, seg_id, {text('ids', 'ids')}, len(ids)::INTEGER AS n_tokens FROM {segs}"


def batches_out(arrays: str, batched: str, masked: str, inputs: str, types: str) -> str:
    """Padded batch rows with inputs and labels: fills follow the last position."""
    return f"""
WITH wide AS (SELECT e.*, b.batch_id, b.row_in_batch, max(e.n_tokens) OVER (PARTITION BY b.batch_id) AS width
              FROM {arrays} e JOIN {batched} b USING (file_key, example_id)),
     lists AS (SELECT file_key, example_id, list({inputs} ORDER BY pos) AS i, list({LABEL} ORDER BY pos) AS l
               FROM {masked} GROUP BY file_key, example_id)
SELECT batch_id, row_in_batch, file_key, example_id, {text('list_resize(i, width, 0::BIGINT)', 'inputs')},
       {text('list_resize(l, width, -100::BIGINT)', 'labels')},
       {text('list_resize(attention_mask, width, 0::BIGINT)', 'attention_mask')}, {types}
FROM wide JOIN lists USING (file_key, example_id)"""


cte("turn_batches", f"""
SELECT file_key, example_id, global_idx // {BATCH_SIZE} AS batch_id,
       (global_idx % {BATCH_SIZE})::INTEGER AS row_in_batch FROM turns_in_order""")

FINAL: dict[str, str] = {
    "scan_lines": "SELECT file_key, row_no::INTEGER AS line_no, line FROM raw",
    "utf8_quarantine": """
SELECT doc_id::VARCHAR AS file_key, CASE WHEN lang IN ('de', 'es') THEN 'rejected' ELSE 'accepted' END AS status,
       CASE WHEN lang = 'de' THEN 2 + 2 * length(text) WHEN lang = 'es' THEN 2 + octet_length(encode(text))
            ELSE octet_length(encode(text)) END::BIGINT AS n_bytes
FROM documents""",
    "raw_line_scan": "SELECT file_key, row_no::INTEGER AS row_no, line FROM raw_pages",
    "concat_sources": """
SELECT 'doc-' || doc_id AS file_key, lang, NULL::VARCHAR AS role, length(text) AS n_chars FROM documents
UNION ALL SELECT 'turn-' || conv_id || '-' || turn, NULL, role, length(text) FROM conversations""",
    "pretokenized_scan": f"SELECT * REPLACE (NULL::VARCHAR AS token_type_ids) FROM (SELECT {EXPORT} FROM single)",
    "cache_roundtrip": f"SELECT {EXPORT} FROM examples",
    "resume_antijoin": "SELECT * FROM stats WHERE file_key NOT IN (SELECT doc_id::VARCHAR FROM labels)",
    "flatten_path_key": "SELECT path, file_key, count(*) OVER (PARTITION BY file_key) AS n_paths FROM flat",
    "split_scan": f"""
SELECT * FROM (SELECT file_key, example_id, n_tokens::INTEGER AS n_tokens, {split_case(0.8, 0.1)}
               FROM examples JOIN cache_split_ranked USING (file_key)) WHERE split = 'val'""",
    "stream_tokenize": f"SELECT {EXPORT} FROM examples",
    "clean_lines": "SELECT file_key, line_no::INTEGER AS line_no, line FROM lines",
    "file_text": "SELECT file_key, text FROM joined",
    "sentence_split": "SELECT file_key, text_no::INTEGER AS text_no, text FROM sentences",
    "sentence_group": "SELECT file_key, text_no::INTEGER AS text_no, text FROM threes",
    "sentence_group_lines": "SELECT file_key, text_no, text FROM threes",
    "build_vocab": "SELECT token, token_id::INTEGER AS token_id FROM vocab",
    "decode_tokens": """
SELECT token_id::INTEGER AS token_id, token, n FROM (SELECT id AS token_id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM segs_overflow) GROUP BY id)
JOIN vocab USING (token_id)""",
    "wordpiece_encode": segs_out("segs_512"),
    "truncate_encode": segs_out("segs"),
    "overflow_encode": segs_out("segs_overflow"),
    "sentence_encode": segs_out("segs_sentences"),
    "user_tokenizer": segs_out("segs_own"),
    "encode_masks": f"SELECT file_key, example_id, {', '.join(text(a, a) for a in ARRAYS[1:])} FROM single",
    "single_segment": f"SELECT {EXPORT} FROM single",
    "pair_segments": "SELECT file_key, example_id, seg_a_id, seg_b_id FROM examples",
    "pair_overflow": """
SELECT file_key, example_id, seg_a_id, seg_b_id, (size_a + size_b)::INTEGER AS n_tokens FROM pairs_overflow""",
    "concat_segments": f"SELECT {EXPORT} FROM cut_examples",
    "global_index": "SELECT global_idx, file_key, example_id FROM in_order",
    "global_index_lookup": f"""
SELECT global_idx, file_key, example_id, {text('ids', 'ids')} FROM in_order JOIN examples USING (file_key, example_id)
WHERE global_idx IN (SELECT doc_id FROM labels)""",
    "split_exact": f"SELECT file_key, {split_case(0.8, 0.1)} FROM split_ranked",
    "split_exact_three": f"SELECT file_key, {split_case(0.7, 0.15, 0.1)} FROM split_ranked",
    "shuffle_batches": "SELECT batch_id, row_in_batch, file_key, example_id FROM shuffled_again",
    "ordered_batches": f"""
SELECT global_idx // {BATCH_SIZE} AS batch_id, (global_idx % {BATCH_SIZE})::INTEGER AS row_in_batch, file_key, example_id
FROM in_order""",
    "pad_file": f"""
SELECT file_key, example_id, seg_a_id, seg_b_id, {padding('width')}, n_tokens::INTEGER AS n_tokens
FROM (SELECT *, max(n_tokens) OVER (PARTITION BY file_key) AS width FROM examples)""",
    "pad_batch": f"""
SELECT batch_id, row_in_batch, file_key, example_id, seg_a_id, seg_b_id, {padding('width')},
       n_tokens::INTEGER AS n_tokens
FROM (SELECT e.*, b.batch_id, b.row_in_batch, max(n_tokens) OVER (PARTITION BY b.batch_id) AS width
      FROM examples e JOIN shuffled b USING (file_key, example_id))""",
    "ordered_batches_padded": f"""
SELECT batch_id, row_in_batch, file_key, example_id, seg_a_id, seg_b_id, {padding('width')}, n_tokens::INTEGER AS n_tokens
FROM (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS width
      FROM (SELECT e.*, global_idx // {BATCH_SIZE} AS batch_id, (global_idx % {BATCH_SIZE})::INTEGER AS row_in_batch
            FROM examples e JOIN in_order USING (file_key, example_id)))""",
    "mlm_select": by_example("mask", selected="selected::INTEGER"),
    "mlm_labels": by_example("mask", labels=LABEL),
    "mlm_mask": by_example("mask", inputs=REPLACED, labels=LABEL),
    "mlm_mask_only": by_example("mask", inputs=MASKED, labels=LABEL),
    "clm_labels": f"SELECT file_key, example_id, {text('ids', 'inputs')}, {text('ids', 'labels')} FROM examples",
    "dynamic_mask_epochs": f"""
SELECT 0::INTEGER AS epoch, * FROM ({by_example('mask', inputs=REPLACED, labels=LABEL)})
UNION ALL SELECT 1::INTEGER, * FROM ({by_example('mask_next', inputs=REPLACED, labels=LABEL)})""",
    "batch_collate": batches_out("examples", "shuffled", "mask", MASKED, text(
        "list_resize(token_type_ids, width, 1::BIGINT)", "token_type_ids")),
    "line_collate": batches_out("single_turns", "turn_batches", "mask_turns", REPLACED,
                                "NULL::VARCHAR AS token_type_ids"),
    "softmax_scores": """
SELECT file_key, example_id, pos::INTEGER AS pos, array_to_string(list(floor(e / total * 1000000 + 0.5)::BIGINT ORDER BY cand), ',') AS probs
FROM (SELECT *, sum(e) OVER (PARTITION BY file_key, example_id, pos) AS total FROM shifted)
GROUP BY file_key, example_id, pos""",
    "sample_tokens": "SELECT file_key, example_id, pos::INTEGER AS pos, token_id::INTEGER AS token_id FROM sampled",
    "argmax_tokens": "SELECT file_key, example_id, pos::INTEGER AS pos, token_id::INTEGER AS token_id FROM best",
    "softmax_dense": """
SELECT file_key, example_id, pos::INTEGER AS pos,
       floor(max(CASE WHEN cand = label THEN exp(logit) END) / sum(exp(logit)) * 1000000 + 0.5)::BIGINT AS prob
FROM dense_logits GROUP BY file_key, example_id, pos""",
    "sample_dense": """
SELECT file_key, example_id, pos::INTEGER AS pos,
       arg_max(cand, (logit - ln(-ln((h::DOUBLE + 0.5) / 4294967296.0::DOUBLE)), -cand))::INTEGER AS token_id
FROM dense_mixed2 GROUP BY file_key, example_id, pos""",
    "argmax_dense": """
SELECT file_key, example_id, pos::INTEGER AS pos, arg_max(cand, (logit, -cand))::INTEGER AS token_id
FROM dense_logits GROUP BY file_key, example_id, pos""",
    "rtd_corrupt": by_example("corrupted", d_inputs="d_input"),
    "rtd_labels": by_example("corrupted", d_labels="d_label"),
    "corpus_stats": "SELECT * FROM stats",
    "corpus_totals": """
SELECT count(*) AS num_files, sum(num_examples)::BIGINT AS num_examples, sum(num_tokens)::BIGINT AS num_tokens
FROM stats""",
    "cache_stats": """
SELECT file_key, count(*) AS num_examples, sum(n_tokens)::BIGINT AS num_tokens FROM examples GROUP BY file_key""",
    "masked_accuracy": "SELECT batch_id, n_active, round(accuracy, 6) AS accuracy FROM g_batches",
    "rtd_accuracy": "SELECT batch_id, n_active, round(accuracy, 6) AS accuracy FROM d_batches",
    "token_cross_entropy": "SELECT batch_id, n_active, round(loss, 6) AS loss FROM d_batches",
    "perplexity": """
SELECT batch_id, n_active, round(loss, 6) AS loss, round(exp(loss), 6) AS perplexity FROM g_batches""",
    "combined_loss": """
SELECT batch_id, round(g.loss, 6) AS g_loss, round(d.loss, 6) AS d_loss, round(g.loss + 50.0 * d.loss, 6) AS loss
FROM g_batches g FULL JOIN d_batches d USING (batch_id)""",
    "epoch_metrics": """
SELECT count(*) AS n_batches, round(avg(g.loss + 50.0 * d.loss), 6) AS loss, round(avg(g.loss), 6) AS g_loss,
       round(avg(d.loss), 6) AS d_loss, round(avg(g.accuracy), 6) AS g_acc, round(avg(d.accuracy), 6) AS d_acc,
       round(exp(avg(g.loss)), 6) AS perplexity
FROM g_batches g FULL JOIN d_batches d USING (batch_id)""",
    "lm_epoch_metrics": """
SELECT count(*) AS n_batches, round(avg(loss), 6) AS val_loss, round(avg(accuracy), 6) AS val_acc,
       round(exp(avg(loss)), 6) AS perplexity
FROM g_batches""",
}


def _needed(sql: str) -> set[str]:
    found, queue = set(), [sql]
    while queue:
        for name in set(re.findall(r"\w+", queue.pop())) & CTE.keys() - found:
            found.add(name)
            queue.append(CTE[name])
    return found


def statements() -> dict[str, str]:
    """Query name -> one self-contained SQL statement."""
    result = {}
    for name, final in FINAL.items():
        needed = _needed(final)
        # a walk refers to itself; everything else is computed once
        parts = [f"{c} AS {'' if c.endswith('_walk') else 'MATERIALIZED '}({CTE[c]})" for c in CTE if c in needed]
        final = final.strip()
        if final.startswith("WITH "):
            parts, final = [*parts, final[len("WITH "):]], ""
            result[name] = "WITH RECURSIVE " + ",\n".join(parts)
        else:
            result[name] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final
    return result
