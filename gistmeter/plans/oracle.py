"""The registered queries as SQL for DuckDB, written without looking at the Spark plans' shape.

Where Spark counts n-grams inside a row, the SQL unnests and groups; where Spark selects by digit, the
SQL ranks; where a bit vector carries a subsequence, the SQL fills the table cell by cell.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Building blocks

SENTENCES = (
    "list_filter(string_split(regexp_replace({0}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda s: s <> '')"
)
TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.conv_id * 1000 + u.turn AS k, u.text AS prediction, a.text AS gold
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

PAIR_TOKENS = f"""{PAIRS}, toks AS MATERIALIZED (
  SELECT conv_id, turn, k, {TOKENS.format("prediction")} AS p, {TOKENS.format("gold")} AS g FROM pairs)"""

DOC_SENTENCES = f"""ds AS (SELECT doc_id, text, {SENTENCES.format("text")} AS s FROM documents)"""

WIDE = f"""{DOC_SENTENCES}, numbered AS (
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM ds),
firsts AS (SELECT doc_id, sentence, min(pos) AS pos FROM numbered GROUP BY ALL),
deduped AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS t FROM firsts GROUP BY doc_id),
longest AS (SELECT doc_id, arg_max(sentence, length(sentence) * 1000000 - pos) AS t FROM numbered GROUP BY doc_id),
wide AS (
  SELECT d.doc_id AS company, d.text AS gold_summary, coalesce(u.t, '') AS deduped, l.t AS longest, d.s[-1] AS closing
  FROM ds d LEFT JOIN deduped u USING (doc_id) LEFT JOIN longest l USING (doc_id)),
melted AS (
  SELECT company, gold_summary, 'deduped' AS model, 0 AS place, deduped AS obtained_summary FROM wide
  UNION ALL SELECT company, gold_summary, 'longest', 1, longest FROM wide
  UNION ALL SELECT company, gold_summary, 'closing', 2, closing FROM wide)"""


def grams(n: int, source: str, column: str) -> str:
    words = f"SELECT k, unnest({column}) AS w, generate_subscripts({column}, 1) AS i FROM {source}"
    parts = " || ' ' || ".join(["w", *[f"lead(w, {step}) OVER line" for step in range(1, n)]])
    filled = "" if n == 1 else f"QUALIFY lead(w, {n - 1}) OVER line IS NOT NULL"
    return f"SELECT k, {parts} AS gram FROM ({words}) WINDOW line AS (PARTITION BY k ORDER BY i) {filled}"


def overlap(n: int, source: str, name: str) -> str:
    """CTE ``name``(k, m): clipped number of shared n-grams."""
    return f"""{name} AS (
  SELECT k, sum(least(cp, cg))::BIGINT AS m FROM (
    SELECT k, gram, count(*) AS cp FROM ({grams(n, source, "p")}) GROUP BY ALL) JOIN (
    SELECT k, gram, count(*) AS cg FROM ({grams(n, source, "g")}) GROUP BY ALL) USING (k, gram)
  GROUP BY k)"""


def prf_columns(hits: str, made: str, asked: str) -> str:
    precision = f"{hits} / greatest({made}, 1)::DOUBLE"
    recall = f"{hits} / greatest({asked}, 1)::DOUBLE"
    return f"{precision} AS precision, {recall} AS recall, {f_value(hits, made, asked)} AS fmeasure"


def f_value(hits: str, made: str, asked: str) -> str:
    precision = f"({hits} / greatest({made}, 1)::DOUBLE)"
    recall = f"({hits} / greatest({asked}, 1)::DOUBLE)"
    return (
        f"CASE WHEN {hits} > 0 THEN 2 * {precision} * {recall} / ({precision} + {recall}) ELSE 0.0::DOUBLE END"
    )


def size_of(column: str, n: int) -> str:
    return f"greatest(len({column}) - {n - 1}, 0)"


def rouge_n(n: int, ctes: str, source: str = "toks") -> str:
    return f"""WITH {ctes}, {overlap(n, source, "o")}
SELECT conv_id, turn, {prf_columns("coalesce(m, 0)", size_of("p", n), size_of("g", n))}
FROM {source} LEFT JOIN o USING (k)"""


# The mteval-v13a rules
def bleu_tokens(text: str) -> str:
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        text = f"replace({text}, {old}, {new})"
    text = f"' ' || {text} || ' '"
    for pattern, new in (
        (r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}\x{2f}])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return (
        f"list_filter(string_split_regex({text}, '[\\x{{09}}-\\x{{0d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\p{{Z}}]+'), "
        "lambda t: t <> '')"
    )


BLEU_PAIRS = f"""{PAIRS}, btoks AS MATERIALIZED (
  SELECT conv_id, turn, k, {bleu_tokens("prediction")} AS p, {bleu_tokens("gold")} AS g FROM pairs)"""


def bleu_counts(source: str, keys: str) -> str:
    """CTE ``bc``: matches and totals per order and the lengths."""
    joins = " ".join(f"LEFT JOIN o{n} USING (k)" for n in (1, 2, 3, 4))
    matches = ", ".join(f"coalesce(o{n}.m, 0) AS m{n}, {size_of('p', n)} AS t{n}" for n in (1, 2, 3, 4))
    overlaps = ", ".join(overlap(n, source, f"o{n}") for n in (1, 2, 3, 4))
    return f"""{overlaps}, bc AS (
  SELECT {keys}, {matches}, len(p) AS made, len(g) AS asked FROM {source} {joins})"""


def bleu_select(source: str, keys: str) -> str:
    p = [f"(CASE WHEN t{n} > 0 THEN m{n} / t{n}::DOUBLE ELSE 0.0 END)" for n in (1, 2, 3, 4)]
    ratio = "(CASE WHEN asked > 0 THEN made / asked::DOUBLE ELSE 0.0 END)"
    brevity = f"(CASE WHEN {ratio} > 1 THEN 1.0 WHEN {ratio} > 0 THEN exp(1 - 1 / {ratio}) ELSE 0.0 END)::DOUBLE"
    logs = " + ".join(f"ln({x}) / 4" for x in p)
    geometric = f"(CASE WHEN least({', '.join(p)}) > 0 THEN exp({logs}) ELSE 0.0 END)::DOUBLE"
    shares = ", ".join(f"round({x}::DOUBLE, 6) AS precision{n}" for n, x in enumerate(p, 1))
    return f"""SELECT {keys} round({geometric} * {brevity}, 6) AS bleu, {shares},
  round({brevity}, 6) AS brevity_penalty, round({ratio}::DOUBLE, 6) AS length_ratio,
  made::BIGINT AS translation_length, asked::BIGINT AS reference_length FROM {source}"""


BLEU_SUMS = (
    ", ".join(f"sum(m{n})::BIGINT AS m{n}, sum(t{n})::BIGINT AS t{n}" for n in (1, 2, 3, 4))
    + ", sum(made)::BIGINT AS made, sum(asked)::BIGINT AS asked"
)

VOCABULARY = f"""dtoks AS (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents),
words AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM dtoks),
counted AS (SELECT token, count(*) AS n FROM words GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM counted),
coded AS (
  SELECT doc_id, list(token_id ORDER BY pos) AS ids FROM words JOIN vocab USING (token) GROUP BY doc_id),
enc AS (SELECT doc_id, list_concat([0], coalesce(ids, []), [2]) AS ids FROM dtoks LEFT JOIN coded USING (doc_id))"""

PADDED = f"""{VOCABULARY},
placed AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY len(ids), doc_id) - 1) // 4 AS batch_id FROM enc),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM placed),
padded AS (
  SELECT doc_id, batch_id, ids, list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: 1)) AS full_ids
  FROM sized)"""

TRIAL_LOG = """log AS (
  SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS training_iteration,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.5::DOUBLE AS epoch,
         value AS eval_rouge1, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS eval_loss
  FROM events)"""

BEST = f"""WITH {TRIAL_LOG}, best AS (
  SELECT *, row_number() OVER (PARTITION BY trial ORDER BY eval_rouge1 DESC, training_iteration) AS r FROM log)
SELECT trial, eval_rouge1, training_iteration, epoch, eval_loss FROM best WHERE r = 1"""

# Scans, projections, selection

ORACLE["scan_project"] = "SELECT doc_id, lang, n_chars FROM documents"

ORACLE["conditional_source"] = """
SELECT 'first' AS run, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_chars FROM documents
UNION ALL
SELECT 'later', count(*), sum(n_chars)::BIGINT FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""

ORACLE["text_lengths"] = f"""
SELECT doc_id, length(text)::BIGINT AS chars, len({TOKENS.format("text")})::BIGINT AS tokens
FROM documents ORDER BY tokens, chars, doc_id"""

ORACLE["topk_rows"] = "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50"

ORACLE["topk_semi_filter"] = """
WITH g AS (SELECT doc_id, (quality * 1000000 + n_chars)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))
SELECT doc_id, score FROM g WHERE doc_id IN (SELECT doc_id FROM g ORDER BY score DESC, doc_id LIMIT 400)"""

ORACLE["select_per_split"] = """
WITH g AS (SELECT doc_id, (quality * 1000000 + n_chars)::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR)) <= ceil(count(*) OVER () / 10.0)
                THEN 'eval' ELSE 'train' END AS split FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, doc_id) AS place FROM s)
SELECT doc_id, score, split FROM r WHERE place <= CASE split WHEN 'train' THEN 400 ELSE 50 END"""

ORACLE["schema_signature"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", CASE any_value(typeof({name})) WHEN 'BIGINT' THEN 'bigint'
WHEN 'VARCHAR' THEN 'string' END AS "type", count({name}) = count(*) AS required FROM documents"""
    for name in ("doc_id", "text", "lang", "source", "n_chars")
)

# Text preparation

ORACLE["sentence_split"] = f"""
WITH {DOC_SENTENCES}
SELECT doc_id, (generate_subscripts(s, 1) - 1)::BIGINT AS pos, unnest(s) AS sentence FROM ds"""

ORACLE["sentence_per_line"] = f"""
SELECT doc_id, array_to_string({SENTENCES.format("trim(text)")}, chr(10)) AS lines FROM documents"""

ORACLE["dedup_sentences"] = f"WITH {WIDE} SELECT company AS doc_id, deduped AS filtered_text FROM wide"

ORACLE["prepare_texts"] = f"""
WITH {WIDE.replace(SENTENCES.format("text"), SENTENCES.format("left(text, 900000)"))}
SELECT company AS doc_id, deduped AS text FROM wide"""

# Reshaping

ORACLE["melt_models"] = f"WITH {WIDE} SELECT company, model, obtained_summary FROM melted"

ORACLE["melt_with_index"] = f"""
WITH {WIDE}
SELECT (row_number() OVER (ORDER BY place, company) - 1)::BIGINT AS "index", company, model,
       length(obtained_summary)::BIGINT AS chars FROM melted"""

# Splits

ORACLE["split_90_10"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR)) <= ceil(count(*) OVER () / 10.0)
  THEN 'eval' ELSE 'train' END AS split FROM documents"""

ORACLE["split_80_10_10"] = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id::VARCHAR)) AS r,
                  ceil(count(*) OVER () / 5.0) AS held FROM documents)
SELECT doc_id, CASE WHEN r <= ceil(held / 2.0) THEN 'eval' WHEN r <= held THEN 'test' ELSE 'train' END AS split FROM r"""

ORACLE["split_shares"] = f"""
WITH s AS ({ORACLE["split_80_10_10"]})
SELECT split, count(*) AS n_rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM s) AS percent FROM s GROUP BY split"""

# Batches, tokens, vocabulary

ORACLE["length_batches"] = """
SELECT doc_id, length(text)::BIGINT AS chars, row_number() OVER (ORDER BY length(text), doc_id) AS rank,
       ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // 4)::BIGINT AS batch_id FROM documents"""

ORACLE["padding_waste"] = f"""
WITH b AS ({ORACLE["length_batches"]})
SELECT batch_id, count(*) AS n_rows, max(chars) AS padded_length, sum(chars)::BIGINT AS real_length,
       round(CASE WHEN max(chars) > 0 THEN 1 - sum(chars)::DOUBLE / (max(chars) * count(*)) ELSE 0 END, 6) AS waste
FROM b GROUP BY batch_id"""

ORACLE["vocab_build"] = f"WITH {VOCABULARY} SELECT token, n, token_id FROM vocab"

ORACLE["vocab_encode"] = f"WITH {VOCABULARY} SELECT doc_id, array_to_string(ids, ' ') AS input_ids FROM enc"

ORACLE["vocab_encode_unseen"] = f"""
WITH {VOCABULARY}, sides AS ({ORACLE["split_90_10"]}),
seen AS (SELECT token, count(*) AS n FROM words JOIN sides USING (doc_id) WHERE split = 'train' GROUP BY token),
ids AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM seen),
known AS (
  SELECT doc_id, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM words LEFT JOIN ids USING (token) GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat([0], coalesce(ids, []), [2]), ' ') AS input_ids
FROM dtoks LEFT JOIN known USING (doc_id)"""

ORACLE["vocab_decode"] = f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS text FROM documents"

ORACLE["token_truncate"] = f"""
WITH {VOCABULARY}
SELECT doc_id, len(ids)::BIGINT AS n_ids, least(len(ids), 4096)::BIGINT AS n_kept,
       ids[least(len(ids), 4096)]::BIGINT AS last_id FROM enc"""

ORACLE["pad_and_mask"] = f"""
WITH {PADDED}
SELECT doc_id, batch_id::BIGINT AS batch_id, array_to_string(full_ids, ' ') AS input_ids,
       repeat('1', len(ids)) || repeat('0', len(full_ids) - len(ids)) AS attention_mask,
       '1' || repeat('0', len(full_ids) - 1) AS global_attention_mask FROM padded"""

ORACLE["label_mask"] = f"""
WITH {PADDED}
SELECT doc_id, array_to_string(ids, ' ') || repeat(' -100', len(full_ids) - len(ids)) AS labels, true AS restored
FROM padded"""

ORACLE["gen_len"] = f"SELECT round(avg(len({TOKENS.format('text')}) + 2), 4) AS gen_len FROM documents"

# Overlap metrics on pairs

ORACLE["rouge1"] = rouge_n(1, PAIR_TOKENS)
ORACLE["rouge2"] = rouge_n(2, PAIR_TOKENS)

# Longest common subsequence: one predicted token at a time over all gold positions. A cell is the running
# maximum of "diagonal + 1" at the matches and the cell above.
LCS = """ptok AS (SELECT k, unnest(p) AS tok, generate_subscripts(p, 1) AS i FROM lt),
cells AS (
  SELECT k, 0::BIGINT AS i, unnest(g) AS tok, generate_subscripts(g, 1) AS j, 0::BIGINT AS l FROM lt
  UNION ALL
  SELECT k, i, tok, j, max(CASE WHEN tok = ptok THEN diagonal + 1 ELSE l END) OVER (PARTITION BY k ORDER BY j)
  FROM (SELECT c.k, c.i + 1 AS i, c.tok, c.j, c.l, t.tok AS ptok,
               lag(c.l, 1, 0) OVER (PARTITION BY c.k ORDER BY c.j) AS diagonal
        FROM cells c JOIN ptok t ON t.k = c.k AND t.i = c.i + 1)),
lcs AS (SELECT k, max(l) AS m FROM cells GROUP BY k)"""

ORACLE["rouge_l"] = f"""WITH RECURSIVE {PAIR_TOKENS}, lt AS (SELECT k, p, g FROM toks), {LCS}
SELECT conv_id, turn, {prf_columns("coalesce(m, 0)", "len(p)", "len(g)")} FROM toks LEFT JOIN lcs USING (k)"""


def lines(text: str, split: bool) -> str:
    if split:
        return SENTENCES.format(f"trim({text})")
    return f"list_filter(string_split({text}, chr(10)), lambda s: s <> '')"


def lsum(split: bool, stem: str = "{0}") -> str:
    """CTEs ending in ``hits``(k, m): clipped union-LCS hits of the CTE ``pairs``.

    The table is filled for every pair of lines, then walked back from its last cell: a match is
    taken, otherwise the walk goes up unless the cell to the left is larger.
    """

    def side(name: str, text: str) -> str:
        words = stem.format("w")
        # The sentence rule leaves line breaks inside a sentence; they part lines as well.
        parted = lines(f"array_to_string({lines(text, split)}, chr(10))", False)
        return f"""{name}l AS (SELECT k, unnest({parted}) AS line, generate_subscripts({parted}, 1) AS s FROM pairs),
{name}w AS (SELECT k, s, unnest({TOKENS.format("line")}) AS w, generate_subscripts({TOKENS.format("line")}, 1) AS i FROM {name}l),
{name}t AS (SELECT k, s, i, {words} AS tok FROM {name}w)"""

    return f"""{side("p", "prediction")}, {side("g", "gold")},
plen AS (SELECT k, s, max(i) AS n FROM pt GROUP BY ALL),
glen AS (SELECT k, s, max(i) AS n FROM gt GROUP BY ALL),
grid AS (
  SELECT plen.k, glen.s AS gs, plen.s AS ps, 0::BIGINT AS i, pt.i AS j, pt.tok, 0::BIGINT AS l
  FROM plen JOIN glen USING (k) JOIN pt ON pt.k = plen.k AND pt.s = plen.s
  UNION ALL
  SELECT k, gs, ps, i, j, tok, max(CASE WHEN tok = gtok THEN diagonal + 1 ELSE l END) OVER (PARTITION BY k, gs, ps ORDER BY j)
  FROM (SELECT c.k, c.gs, c.ps, c.i + 1 AS i, c.j, c.tok, c.l, t.tok AS gtok,
               lag(c.l, 1, 0) OVER (PARTITION BY c.k, c.gs, c.ps ORDER BY c.j) AS diagonal
        FROM grid c JOIN gt t ON t.k = c.k AND t.s = c.gs AND t.i = c.i + 1)),
steps AS (
  SELECT g.k, g.gs, g.ps, g.i, g.j, t.tok = g.tok AS hit,
         coalesce(w.l, 0) > coalesce(n.l, 0) AS go_left
  FROM grid g JOIN gt t ON t.k = g.k AND t.s = g.gs AND t.i = g.i
  LEFT JOIN grid w ON w.k = g.k AND w.gs = g.gs AND w.ps = g.ps AND w.i = g.i AND w.j = g.j - 1
  LEFT JOIN grid n ON n.k = g.k AND n.gs = g.gs AND n.ps = g.ps AND n.i = g.i - 1 AND n.j = g.j
  WHERE g.i > 0),
walk AS (
  SELECT s.* FROM steps s JOIN glen ON glen.k = s.k AND glen.s = s.gs AND glen.n = s.i
  JOIN plen ON plen.k = s.k AND plen.s = s.ps AND plen.n = s.j
  UNION ALL
  SELECT s.* FROM walk w JOIN steps s ON s.k = w.k AND s.gs = w.gs AND s.ps = w.ps
    AND s.i = CASE WHEN w.hit OR NOT w.go_left THEN w.i - 1 ELSE w.i END
    AND s.j = CASE WHEN w.hit OR w.go_left THEN w.j - 1 ELSE w.j END),
covered AS (SELECT DISTINCT k, gs, i FROM walk WHERE hit),
used AS (SELECT c.k, t.tok, count(*) AS n FROM covered c JOIN gt t ON t.k = c.k AND t.s = c.gs AND t.i = c.i GROUP BY ALL),
offered AS (SELECT k, tok, count(*) AS n FROM pt GROUP BY ALL),
hits AS (SELECT k, sum(least(used.n, offered.n))::BIGINT AS m FROM used JOIN offered USING (k, tok) GROUP BY k),
psum AS (SELECT k, count(*) AS n FROM pt GROUP BY k),
gsum AS (SELECT k, count(*) AS n FROM gt GROUP BY k)"""


LSUM_JOIN = "LEFT JOIN hits USING (k) LEFT JOIN psum USING (k) LEFT JOIN gsum USING (k)"
LSUM_ARGS = ("coalesce(hits.m, 0)", "coalesce(psum.n, 0)", "coalesce(gsum.n, 0)")

ORACLE["rouge_lsum"] = f"""WITH RECURSIVE {PAIRS}, {lsum(True)}
SELECT conv_id, turn, {prf_columns(*LSUM_ARGS)} FROM pairs {LSUM_JOIN}"""

ORACLE["bleu_row"] = f"""WITH {BLEU_PAIRS}, {bleu_counts("btoks", "conv_id, turn")}
{bleu_select("bc", "conv_id, turn,")}"""

ORACLE["bleu_corpus"] = f"""WITH {BLEU_PAIRS}, {bleu_counts("btoks", "k")},
total AS (SELECT {BLEU_SUMS} FROM bc) {bleu_select("total", "")}"""

MODEL_BLEU = f"""{WIDE}, mtoks AS MATERIALIZED (
  SELECT company, model, company * 10 + place AS k, {bleu_tokens("coalesce(obtained_summary, '')")} AS p,
         {bleu_tokens("gold_summary")} AS g FROM melted)"""

ORACLE["bleu_by_model"] = f"""WITH {MODEL_BLEU}, {bleu_counts("mtoks", "model")},
total AS (SELECT model, {BLEU_SUMS} FROM bc GROUP BY model) {bleu_select("total", "model,")}"""

MODEL_TOKENS = f"""{WIDE}, mtoks AS MATERIALIZED (
  SELECT company, model, company * 10 + place AS k, {TOKENS.format("coalesce(obtained_summary, '')")} AS p,
         {TOKENS.format("gold_summary")} AS g FROM melted)"""

ORACLE["summaries_rouge"] = f"""WITH {MODEL_TOKENS}, {overlap(1, "mtoks", "o1")}, {overlap(2, "mtoks", "o2")}
SELECT company, model, {f_value("coalesce(o1.m, 0)", size_of("p", 1), size_of("g", 1))} AS rouge1,
       {f_value("coalesce(o2.m, 0)", size_of("p", 2), size_of("g", 2))} AS rouge2
FROM mtoks LEFT JOIN o1 USING (k) LEFT JOIN o2 USING (k)"""

# Cumulative probabilities of a Poisson(1) draw.
POISSON = (
    "[0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, "
    "0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, "
    "0.9999999899522336]::DOUBLE[]"
)

PAIR_F = f"""{PAIR_TOKENS}, {overlap(1, "toks", "o1")}, {overlap(2, "toks", "o2")}, scored AS (
  SELECT conv_id, turn, {f_value("coalesce(o1.m, 0)", size_of("p", 1), size_of("g", 1))} AS rouge1,
         {f_value("coalesce(o2.m, 0)", size_of("p", 2), size_of("g", 2))} AS rouge2
  FROM toks LEFT JOIN o1 USING (k) LEFT JOIN o2 USING (k))"""

ORACLE["bootstrap_ci"] = f"""WITH {PAIR_F}, digests AS (
  SELECT rouge1, rouge2, b, md5('42:' || b || ':' || conv_id || '-' || turn) AS d
  FROM scored, (SELECT unnest(range(0, 250)) AS b)),
draws AS (
  SELECT b, w, rouge1, rouge2,
         len(list_filter({POISSON}, lambda c: ('0x' || substr(d, 8 * w + 1, 8))::BIGINT / 4294967296.0::DOUBLE >= c)) AS x
  FROM digests, (SELECT unnest(range(0, 4)) AS w)),
means AS (
  SELECT sum(x * rouge1) / sum(x) AS rouge1, sum(x * rouge2) / sum(x) AS rouge2 FROM draws GROUP BY b, w)
SELECT 'rouge1' AS metric, round(quantile_cont(rouge1, 0.025), 6) AS low, round(quantile_cont(rouge1, 0.5), 6) AS mid,
       round(quantile_cont(rouge1, 0.975), 6) AS high FROM means
UNION ALL
SELECT 'rouge2', round(quantile_cont(rouge2, 0.025), 6), round(quantile_cont(rouge2, 0.5), 6),
       round(quantile_cont(rouge2, 0.975), 6) FROM means"""

BIAS = """rated AS (
  SELECT doc_id, CASE WHEN toxic = 0 THEN 'Non-biased' ELSE 'Biased' END AS label,
         CASE WHEN toxic = 0 THEN 1 - (doc_id % 100) / 100.0::DOUBLE ELSE (doc_id % 100) / 100.0::DOUBLE END AS bias
  FROM labels)"""

ORACLE["bias_score"] = f"WITH {BIAS} SELECT doc_id, label, round(bias, 6) AS bias FROM rated"

ORACLE["penalized_score"] = f"""WITH {MODEL_TOKENS}, longs AS (SELECT * FROM mtoks WHERE model = 'longest'),
{overlap(1, "longs", "o1")}, {BIAS},
v AS (SELECT label, {f_value("coalesce(o1.m, 0)", size_of("p", 1), size_of("g", 1))} * 80 + 20
             - greatest(bias - 0.45, 0) * 20 AS x
      FROM longs LEFT JOIN o1 USING (k) JOIN rated ON rated.doc_id = company)
SELECT label, count(*) AS n_rows, round(avg(x), 4) AS penalized FROM v GROUP BY label"""

# Vectors

ORACLE["mean_pool"] = """
WITH e AS (SELECT label, embedding AS v, CASE WHEN embedding[1] >= 0 THEN 1 ELSE 0 END AS m FROM embeddings),
x AS (SELECT label, m, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) - 1 AS pos FROM e)
SELECT label, pos::BIGINT AS pos, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS value FROM x GROUP BY label, pos"""

ORACLE["l2_normalized"] = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id, pos::BIGINT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM x"""

ORACLE["paired_cosine"] = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
SELECT (a.vec_id // 2)::BIGINT AS pair, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS cosine
FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id"""

TOKEN_VECTORS = f"""{PAIRS}, sides AS (
  SELECT k, 'p' AS side, {TOKENS.format("prediction")} AS t FROM pairs
  UNION ALL SELECT k, 'g', {TOKENS.format("gold")} FROM pairs),
words AS (SELECT k, side, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM sides),
ided AS (SELECT k, side, pos, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id
         FROM words)"""

COSINE = """pool AS (
  SELECT k, side, d, avg(x) AS x FROM (
    SELECT k, side, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
    FROM ided JOIN embeddings USING (vec_id)) GROUP BY ALL),
cosines AS (
  SELECT a.k, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine
  FROM pool a JOIN pool b ON a.k = b.k AND a.d = b.d AND a.side = 'p' AND b.side = 'g' GROUP BY a.k)"""

ORACLE["text_cosine"] = f"""WITH {TOKEN_VECTORS}, {COSINE}
SELECT conv_id, turn, round(cosine, 6) AS cosine FROM pairs LEFT JOIN cosines USING (k)"""

MATCHES = """unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
wanted AS (SELECT DISTINCT a.vec_id AS x, b.vec_id AS y FROM ided a JOIN ided b ON a.k = b.k AND a.side = 'p' AND b.side = 'g'),
sims AS (
  SELECT x, y, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c
  FROM wanted JOIN unit a ON a.vec_id = x JOIN unit b ON b.vec_id = y),
bests AS (
  SELECT a.k, a.pos AS i, b.pos AS j, c FROM ided a JOIN ided b ON a.k = b.k AND a.side = 'p' AND b.side = 'g'
  JOIN sims ON x = a.vec_id AND y = b.vec_id),
mp AS (SELECT k, avg(c) AS p FROM (SELECT k, i, max(c) AS c FROM bests GROUP BY ALL) GROUP BY k),
mr AS (SELECT k, avg(c) AS r FROM (SELECT k, j, max(c) AS c FROM bests GROUP BY ALL) GROUP BY k)"""

ORACLE["greedy_match_score"] = f"""WITH {TOKEN_VECTORS}, {MATCHES}
SELECT conv_id, turn, round(coalesce(p, 0), 6) AS match_precision, round(coalesce(r, 0), 6) AS match_recall,
       round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS match_f1
FROM pairs LEFT JOIN mp USING (k) LEFT JOIN mr USING (k)"""

# Prediction and joins

SUMMARIES = f"""{DOC_SENTENCES},
lines AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM ds),
words AS (SELECT doc_id, pos, unnest({TOKENS.format("sentence")}) AS tok FROM lines),
uses AS (SELECT doc_id, tok, count(*) AS n FROM words GROUP BY ALL),
scores AS (SELECT doc_id, pos, sum(n)::DOUBLE / count(*) AS score FROM words JOIN uses USING (doc_id, tok) GROUP BY ALL),
best AS (
  SELECT doc_id, sentence, coalesce(score, 0) AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, pos) AS r
  FROM lines LEFT JOIN scores USING (doc_id, pos)),
made AS (
  SELECT d.doc_id, d.text, coalesce(sentence, '') AS prediction, coalesce(score, 0) AS score
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND r = 1)"""

ORACLE["batch_summarize"] = f"""WITH {SUMMARIES}
SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS rank,
       ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // 4)::BIGINT AS batch_id, prediction,
       round(score, 6) AS score FROM made"""

ORACLE["join_predictions"] = f"""WITH {SUMMARIES}
SELECT doc_id, lang, source, length(d.text)::BIGINT AS length, prediction FROM documents d JOIN made USING (doc_id)"""

ORACLE["latency_summary"] = """
SELECT event_type AS configuration, count(*) AS steps, round(sum(value), 4) AS total_seconds,
       round(avg(value), 4) AS mean_seconds, round(min(value), 4) AS min_seconds, round(max(value), 4) AS max_seconds
FROM events GROUP BY event_type"""

ORACLE["latency_percentiles"] = """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type AS configuration, max(value) FILTER (r = (n * 50 + 99) // 100) AS p50_seconds,
       max(value) FILTER (r = (n * 90 + 99) // 100) AS p90_seconds,
       max(value) FILTER (r = (n * 99 + 99) // 100) AS p99_seconds FROM r GROUP BY event_type"""

# Trial logs

ORACLE["rank_in_trial"] = """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events"""

ORACLE["trial_best_epoch"] = BEST

ORACLE["trial_leaderboard"] = f"""
SELECT * FROM ({BEST}) WHERE eval_rouge1 > 0 ORDER BY eval_rouge1 DESC, trial LIMIT 1"""

ORACLE["trial_plateau"] = f"""WITH {TRIAL_LOG}, w AS (
  SELECT trial, training_iteration,
         stddev_pop(eval_rouge1) OVER last4 AS spread, count(*) OVER last4 AS n
  FROM log WINDOW last4 AS (PARTITION BY trial ORDER BY training_iteration ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT trial, min(training_iteration) AS stop_iteration FROM w WHERE n = 4 AND spread < 10 GROUP BY trial"""

ORACLE["trial_metric_history"] = f"""WITH {TRIAL_LOG}
SELECT trial, floor(epoch)::BIGINT AS step, 'eval_rouge1' AS key, eval_rouge1 AS value FROM log
UNION ALL SELECT trial, floor(epoch)::BIGINT, 'eval_loss', eval_loss FROM log"""

ORACLE["trial_log_flatten"] = """
SELECT event_type AS trial, event_id, value AS eval_rouge1, event_id * 0.5::DOUBLE AS epoch,
       event_id + 1 AS training_iteration, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS config_k FROM events"""

ORACLE["trial_params_join"] = """
SELECT event_type AS trial, count(*) AS n_results, max(value) AS best, min(value) AS learning_rate,
       max(regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT) AS num_train_epochs FROM events GROUP BY event_type"""

ORACLE["latest_per_group"] = """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""

ORACLE["latest_file"] = """
SELECT event_type AS trial, 'checkpoint_1' AS checkpoint, count(*) AS n_rows FROM events WHERE value > 10 GROUP BY event_type"""

# Sinks

ORACLE["overwrite_readback"] = f"WITH {WIDE} SELECT company AS doc_id, length(deduped)::BIGINT AS chars FROM wide"

ORACLE["create_keyed_table"] = f"WITH {PAIR_F} SELECT conv_id, turn, rouge1 FROM scored"

ORACLE["key_violations"] = """
SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY conv_id HAVING count(*) > 1 OR conv_id IS NULL"""

ORACLE["upsert_by_key"] = """
SELECT doc_id, quality::VARCHAR || '/' || toxic::VARCHAR AS state FROM labels
UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

# Word stems: suffix rules over the distinct words. A ``y`` that acts as a consonant is written ``Y``,
# so that vowels and consonants are plain character classes.

POSITIVE = "regexp_matches({0}, '[aeiouy][^aeiouy]')"
ABOVE_ONE = "regexp_matches({0}, '[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]')"
SHORT = "regexp_matches({0}, '([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$')"

# Suffix rules in their order.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def suffix_rules(rules: list[tuple[str, str]], condition: str) -> str:
    cases = "".join(
        f" WHEN w LIKE '%{suffix}' THEN CASE WHEN {condition.format(cut(len(suffix)))}"
        f"{' AND regexp_matches(w, ' + chr(39) + '[st]ion$' + chr(39) + ')' if suffix == 'ion' else ''}"
        f" THEN {cut(len(suffix))} || '{new}' ELSE w END"
        for suffix, new in rules
    )
    return f"CASE{cases} ELSE w END"


def stem_ctes(words: str) -> str:
    """CTEs ending in ``stems``(word, tok) for the words of a query that yields ``word``."""
    fixed = "".join(f" WHEN '{word}' THEN '{stem}'" for word, stem in IRREGULAR.items())
    one_vowel = "regexp_matches({0}, '[aeiouy]')"
    steps = [
        f"""CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN {cut(1)} WHEN w LIKE '%sses' THEN {cut(2)}
            WHEN w LIKE '%ies' THEN {cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {cut(1)} ELSE w END""",
        f"""CASE WHEN w LIKE '%ied' THEN CASE WHEN length(w) = 4 THEN {cut(1)} ELSE {cut(2)} END
            WHEN w LIKE '%eed' THEN CASE WHEN {POSITIVE.format(cut(3))} THEN {cut(1)} ELSE w END
            WHEN w LIKE '%ed' AND {one_vowel.format(cut(2))} THEN {cut(2)} || '+'
            WHEN w LIKE '%ing' AND {one_vowel.format(cut(3))} THEN {cut(3)} || '+' ELSE w END""",
        # The plus sign marks a word that just lost its ending.
        f"""CASE WHEN w NOT LIKE '%+' THEN w WHEN regexp_matches(w, '(at|bl|iz)[+]$') THEN {cut(1)} || 'e'
            WHEN length(w) > 2 AND lower(substr(w, length(w) - 1, 1)) = lower(substr(w, length(w) - 2, 1))
                 AND regexp_matches(w, '[^aeiouy][+]$')
            THEN CASE WHEN regexp_matches(w, '[lsz][+]$') THEN {cut(1)} ELSE {cut(2)} END
            WHEN {POSITIVE.format(cut(1))} AND NOT {ABOVE_ONE.format(cut(1))} AND {SHORT.format(cut(1))}
            THEN {cut(1)} || 'e' ELSE {cut(1)} END""",
        f"CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN {cut(1)} || 'i' ELSE w END",
        f"CASE WHEN w LIKE '%alli' AND {POSITIVE.format(cut(4))} THEN {cut(2)} ELSE w END",
        f"""CASE WHEN w LIKE '%logi' THEN CASE WHEN {POSITIVE.format(cut(3))} THEN {cut(1)} ELSE w END
            ELSE {suffix_rules(STEP_2, POSITIVE)} END""",
        suffix_rules(STEP_3, POSITIVE),
        suffix_rules([(suffix, "") for suffix in STEP_4], ABOVE_ONE),
        f"""CASE WHEN w LIKE '%e' AND ({ABOVE_ONE.format(cut(1))} OR ({POSITIVE.format(cut(1))}
            AND NOT {SHORT.format(cut(1))})) THEN {cut(1)} ELSE w END""",
        f"CASE WHEN w LIKE '%ll' AND {ABOVE_ONE.format(cut(1))} THEN {cut(1)} ELSE w END",
    ]
    marked = "regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"
    ctes = f"st0 AS (SELECT DISTINCT word, {marked} AS w FROM ({words}))"
    for number, step in enumerate(steps, 1):
        ctes += f",\nst{number} AS MATERIALIZED (SELECT word, {step} AS w FROM st{number - 1})"
    return f"""{ctes}, stems AS MATERIALIZED (
  SELECT word, CASE WHEN length(word) <= 3 THEN word ELSE CASE word{fixed} ELSE lower(w) END END AS tok FROM st{len(steps)})"""


ALL_WORDS = f"""SELECT unnest({TOKENS.format("prediction")}) AS word FROM pairs
UNION ALL SELECT unnest({TOKENS.format("gold")}) FROM pairs"""

STEMMED = f"""{PAIRS}, {stem_ctes(ALL_WORDS)}, raw AS (
  SELECT conv_id, turn, k, {TOKENS.format("prediction")} AS p, {TOKENS.format("gold")} AS g FROM pairs),
stem_p AS (SELECT k, unnest(p) AS word, generate_subscripts(p, 1) AS i FROM raw),
stem_g AS (SELECT k, unnest(g) AS word, generate_subscripts(g, 1) AS i FROM raw),
list_p AS (SELECT k, list(tok ORDER BY i) AS p FROM stem_p JOIN stems USING (word) GROUP BY k),
list_g AS (SELECT k, list(tok ORDER BY i) AS g FROM stem_g JOIN stems USING (word) GROUP BY k),
toks AS MATERIALIZED (
  SELECT raw.conv_id, raw.turn, k, coalesce(list_p.p, []) AS p, coalesce(list_g.g, []) AS g
  FROM raw LEFT JOIN list_p USING (k) LEFT JOIN list_g USING (k))"""

ORACLE["rouge1_stemmed"] = rouge_n(1, STEMMED)

FOUR_F = f"""SELECT conv_id, turn, {f_value("coalesce(o1.m, 0)", size_of("p", 1), size_of("g", 1))} AS rouge1,
  {f_value("coalesce(o2.m, 0)", size_of("p", 2), size_of("g", 2))} AS rouge2,
  {f_value("coalesce(lcs.m, 0)", "len(p)", "len(g)")} AS rougel, {f_value(*LSUM_ARGS)} AS rougelsum, len(p) AS made
  FROM toks LEFT JOIN o1 USING (k) LEFT JOIN o2 USING (k) LEFT JOIN lcs USING (k) {LSUM_JOIN}"""

ORACLE["rouge_corpus"] = f"""WITH RECURSIVE {STEMMED}, {overlap(1, "toks", "o1")}, {overlap(2, "toks", "o2")},
lt AS (SELECT k, p, g FROM toks), {LCS}, {lsum(True, "(SELECT tok FROM stems WHERE stems.word = {0})")},
four AS ({FOUR_F})
SELECT round(avg(rouge1) * 100, 4) AS rouge1, round(avg(rouge2) * 100, 4) AS rouge2, round(avg(rougel) * 100, 4) AS rougel,
       round(avg(rougelsum) * 100, 4) AS rougelsum, round(avg(made), 4) AS gen_len FROM four"""

# Pairs as they come back from their ids: words that no gold text has are skipped with the special ids.
DECODED_PAIRS = f"""{PAIRS.replace("pairs AS", "spoken AS", 1)},
gold_words AS (SELECT DISTINCT unnest({TOKENS.format("gold")}) AS w FROM spoken),
said AS (SELECT k, unnest({TOKENS.format("prediction")}) AS w, generate_subscripts({TOKENS.format("prediction")}, 1) AS i FROM spoken),
heard AS (SELECT k, string_agg(w, ' ' ORDER BY i) AS t FROM said JOIN gold_words USING (w) GROUP BY k),
pairs AS MATERIALIZED (
  SELECT conv_id, turn, k, coalesce(t, '') AS prediction, array_to_string({TOKENS.format("gold")}, ' ') AS gold
  FROM spoken LEFT JOIN heard USING (k))"""

ORACLE["evaluate_ids"] = f"""WITH RECURSIVE {STEMMED.replace(PAIRS, DECODED_PAIRS)}, {overlap(1, "toks", "o1")}, {overlap(2, "toks", "o2")},
lt AS (SELECT k, p, g FROM toks), {LCS}, {lsum(True, "(SELECT tok FROM stems WHERE stems.word = {0})")},
four AS ({FOUR_F})
SELECT round(avg(rouge1) * 100, 4) AS rouge1, round(avg(rouge2) * 100, 4) AS rouge2, round(avg(rougel) * 100, 4) AS rougel,
       round(avg(rougelsum) * 100, 4) AS rougelsum,
       (SELECT round(avg(len({TOKENS.format("prediction")}) + 2), 4) FROM spoken) AS gen_len FROM four"""

# A model per row: the whole prediction and its closing sentence.
WIDE_PAIRS = f"""{PAIRS.replace("pairs AS", "spoken AS", 1)},
pairs AS MATERIALIZED (
  SELECT conv_id, turn, 'whole' AS model, k * 2 AS k, prediction, gold FROM spoken
  UNION ALL SELECT conv_id, turn, 'closing', k * 2 + 1, coalesce({SENTENCES.format("prediction")}[-1], ''), gold FROM spoken),
toks AS MATERIALIZED (SELECT conv_id, turn, model, k, {TOKENS.format("prediction")} AS p, {TOKENS.format("gold")} AS g FROM pairs),
btoks AS MATERIALIZED (SELECT conv_id, turn, model, k, {bleu_tokens("prediction")} AS p, {bleu_tokens("gold")} AS g FROM pairs)"""

ORACLE["scored_wide_pairs"] = f"""WITH RECURSIVE {WIDE_PAIRS}, {overlap(1, "toks", "r1")}, {overlap(2, "toks", "r2")},
lt AS (SELECT k, p, g FROM toks), {LCS}, {lsum(False)},
four AS ({FOUR_F.replace("conv_id, turn,", "conv_id, turn, model,", 1).replace("o1", "r1").replace("o2", "r2")}),
{bleu_counts("btoks", "conv_id, turn, model")}, bleus AS ({bleu_select("bc", "conv_id, turn, model,")})
SELECT bleus.*, rouge1, rouge2, rougel, rougelsum FROM four JOIN bleus USING (conv_id, turn, model)"""

ORACLE["summaries_overlap"] = f"""WITH rouges AS ({ORACLE["summaries_rouge"]}),
bleus AS (WITH {MODEL_BLEU}, {bleu_counts("mtoks", "company, model")} {bleu_select("bc", "company, model,")})
SELECT bleus.*, rouge1, rouge2 FROM rouges JOIN bleus USING (company, model)"""

ORACLE["scored_pairs"] = f"""WITH RECURSIVE {PAIR_TOKENS}, {overlap(1, "toks", "o1")}, {overlap(2, "toks", "o2")},
lt AS (SELECT k, p, g FROM toks), {LCS}, {lsum(False)}, four AS ({FOUR_F}), bleus AS ({ORACLE["bleu_row"]}),
cosine AS ({ORACLE["text_cosine"]}), matches AS ({ORACLE["greedy_match_score"]})
SELECT conv_id, turn, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougel, 6) AS rougel,
       round(rougelsum, 6) AS rougelsum, bleu, brevity_penalty, length_ratio, translation_length, reference_length,
       cosine, match_precision, match_recall, match_f1
FROM four JOIN bleus USING (conv_id, turn) LEFT JOIN cosine USING (conv_id, turn) LEFT JOIN matches USING (conv_id, turn)"""

# Each summary is made of sentences of its text in their order, so all of its tokens are a subsequence of the text's.
ORACLE["summaries_scored"] = f"""WITH {MODEL_TOKENS}, {overlap(1, "mtoks", "o1")}, {overlap(2, "mtoks", "o2")},
four AS (
  SELECT company, model, k, round({f_value("coalesce(o1.m, 0)", size_of("p", 1), size_of("g", 1))}, 6) AS rouge1,
         round({f_value("coalesce(o2.m, 0)", size_of("p", 2), size_of("g", 2))}, 6) AS rouge2,
         round({f_value("len(p)", "len(p)", "len(g)")}, 6) AS rougel,
         len(p) AS np, len(g) AS ng
  FROM mtoks LEFT JOIN o1 USING (k) LEFT JOIN o2 USING (k)),
bleus AS (WITH {MODEL_BLEU}, {bleu_counts("mtoks", "company, model")} {bleu_select("bc", "company, model,")}),
sided AS (SELECT k, 'p' AS side, unnest(p) AS token FROM mtoks UNION ALL SELECT k, 'g', unnest(g) FROM mtoks),
ided AS MATERIALIZED (
  SELECT k, side, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id, count(*) AS n
  FROM sided GROUP BY ALL),
parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
pool AS MATERIALIZED (SELECT k, side, d, sum(n * x) / sum(n) AS x FROM ided JOIN parts USING (vec_id) GROUP BY ALL),
cosines AS (
  SELECT a.k, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine
  FROM pool a JOIN pool b ON a.k = b.k AND a.d = b.d AND a.side = 'p' AND b.side = 'g' GROUP BY a.k),
unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sims AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y,
         list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c
  FROM unit a, unit b),
met AS (
  SELECT a.k, a.vec_id AS x, a.n AS nx, b.vec_id AS y, b.n AS ny, c FROM ided a
  JOIN ided b ON a.k = b.k AND a.side = 'p' AND b.side = 'g' JOIN sims ON x = a.vec_id AND y = b.vec_id),
mp AS (SELECT k, sum(nx * c) AS m FROM (SELECT k, x, nx, max(c) AS c FROM met GROUP BY ALL) GROUP BY k),
mr AS (SELECT k, sum(ny * c) AS m FROM (SELECT k, y, ny, max(c) AS c FROM met GROUP BY ALL) GROUP BY k),
places AS ({ORACLE["melt_with_index"]}),
matched AS (
  SELECT k, coalesce(mp.m / np, 0) AS p, coalesce(mr.m / ng, 0) AS r FROM four LEFT JOIN mp USING (k) LEFT JOIN mr USING (k))
SELECT places."index", bleus.*, rouge1, rouge2, rougel, round(cosine, 6) AS cosine, round(p, 6) AS match_precision,
       round(r, 6) AS match_recall, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS match_f1
FROM four JOIN bleus USING (company, model) JOIN places USING (company, model) JOIN matched USING (k) LEFT JOIN cosines USING (k)"""
