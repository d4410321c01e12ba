"""DuckDB SQL for every registered query (the correctness oracle), written independently in SQL."""

from __future__ import annotations

from textlab import schema as S
from textlab.functions.stem import STEP2, STEP3, STEP4
from textlab.functions.text import english_stop_words
from textlab.plans import catalog as C
from textlab.plans.oracle import BASE_CTE, LABELED_CTE, clean_sql, q, tokens_sql, words_sql


def _dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def _tier_case(col: str) -> str:
    parts = [f"WHEN {col} >= {_dbl(t)} THEN {q(lab)}" for _n, t, _c, lab in S.SHIPPED_CONFIDENCE_RULES]
    return "CASE " + " ".join(parts) + " END"


def _category_case() -> str:
    parts = []
    for s, levels in C.CATEGORY_RULES.items():
        for _l, t, lab in levels:
            parts.append(f"WHEN sentiment = {q(s)} AND confidence >= {_dbl(t)} THEN {q(lab)}")
    return "CASE " + " ".join(parts) + " END"


def _popularity_case() -> str:
    return _popularity_case_on("coalesce(favorite_count, 0)", "sentiment")


def _popularity_case_on(lk: str, sentiment: str) -> str:
    viral = " ".join(f"WHEN {sentiment} = {q(k)} THEN {q(v)}" for k, v in S.VIRAL_LABELS.items())
    return (f"CASE WHEN {lk} >= {S.VIRAL_THRESHOLD} THEN (CASE {viral} END) "
            f"WHEN {lk} >= {S.POPULAR_THRESHOLD} THEN {q(S.POPULAR_LABEL)} ELSE {q(S.NORMAL_LABEL)} END")


CLEAN_DOCS = f"cd AS (SELECT doc_id AS id, {clean_sql('text')} AS t FROM documents)"

FEATURES = f""",
feat AS (
  SELECT id, len(list_filter({words_sql('preprocessed_text')}, lambda w: list_contains({_list(C.POSITIVE_WORDS)}, w))) AS kata_positif,
         len(list_filter({words_sql('preprocessed_text')}, lambda w: list_contains({_list(C.NEGATIVE_WORDS)}, w))) AS kata_negatif,
         length(text) - length(replace(text, '!', '')) AS jumlah_tanda_seru,
         len({words_sql('preprocessed_text')}) AS jumlah_kata,
         coalesce(favorite_count, 0) AS skor_likes, 0 AS skor_dislikes
  FROM labeled)"""

MINED = """,
pats AS (SELECT sentiment, floor(confidence * 10) / 10 AS conf_range, count(*) AS n, min(id) AS first_seen
         FROM labeled GROUP BY sentiment, floor(confidence * 10) / 10),
lv AS (SELECT *, CASE WHEN conf_range >= 0.8 THEN 'very_high' WHEN conf_range >= 0.6 THEN 'high'
                      WHEN conf_range >= 0.4 THEN 'medium' ELSE 'low' END AS level
       FROM pats WHERE n > 10),
rk AS (SELECT sentiment, level, arg_max(conf_range, first_seen) AS threshold, arg_max(n, first_seen) AS count,
              min(first_seen) AS kfs FROM lv GROUP BY sentiment, level),
mined AS (
  SELECT 'confidence_rules' AS rule_type, sentiment || '_' || level AS rule_name,
         CAST(row_number() OVER (ORDER BY kfs) AS INTEGER) AS ordinal, threshold, count,
         (CASE level WHEN 'very_high' THEN 'Very High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium'
               ELSE 'Low' END) || ' ' || upper(left(sentiment, 1)) || substr(sentiment, 2) AS label
  FROM rk)"""

VIEW = """,
view AS (
  SELECT t.id, t.text, t.preprocessed_text, s.sentiment, s.confidence, m.favorite_count, t.created_at,
         m.location, m.username, t.source_dataset
  FROM texts t JOIN sentiments s ON t.id = s.text_id LEFT JOIN metadata m ON t.id = m.text_id)"""

SPLIT = f""",
split AS (
  SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('{S.SPLIT_SEED}:' || CAST(id AS VARCHAR)), id) - 1
                       < floor(count(*) OVER () * {C.TRAIN_PERCENT} / 100.0) THEN 'train' ELSE 'test' END AS split_type
  FROM labeled)"""

DOC_TERMS = f"""{CLEAN_DOCS},
dt AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens_sql('t')}) AS term FROM cd) GROUP BY id, term),
ts AS (SELECT term, sum(tf) AS n, count(*) AS df FROM dt GROUP BY term),
top AS (SELECT term, n, df FROM ts ORDER BY n DESC, term LIMIT {S.MAX_FEATURES}),
vocab AS (SELECT term, n, df, CAST(row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS rank,
                 CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top),
tv AS (SELECT dt.id, dt.term, vocab.idx, dt.tf FROM dt JOIN vocab ON dt.term = vocab.term)"""

PRED = """,
pt AS (SELECT l.id, l.sentiment AS predicted, t.actual FROM labeled l JOIN truth t ON l.id = t.id),
grid AS (SELECT a.s AS actual, p.s AS predicted FROM (VALUES ('negative'), ('neutral'), ('positive')) a(s),
                (VALUES ('negative'), ('neutral'), ('positive')) p(s)),
cm AS (SELECT g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid g
       LEFT JOIN (SELECT actual, predicted, count(*) AS n FROM pt GROUP BY actual, predicted) c
       ON g.actual = c.actual AND g.predicted = c.predicted)"""

DOMAIN = "(VALUES ('negative'), ('neutral'), ('positive')) dom(sentiment)"

_SOCIAL = q(r"^\s*[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{1,2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})\s*$")
_PARSED = (f"coalesce(CASE WHEN regexp_matches(raw, {_SOCIAL}) THEN try_strptime("
           f"regexp_extract(raw, {_SOCIAL}, 1) || ' ' || regexp_extract(raw, {_SOCIAL}, 2) || ' ' || "
           f"regexp_extract(raw, {_SOCIAL}, 3) || ' ' || regexp_extract(raw, {_SOCIAL}, 4), '%b %d %H:%M:%S %Y') END, "
           f"try_strptime(trim(raw), '%Y-%m-%d %H:%M:%S'))")

_RAW_DATES = """raw AS (SELECT event_id, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                   WHEN event_type = 'error' THEN 'not a date' WHEN event_type = 'click' THEN NULL
                   ELSE strftime(ts, '%a %b %d %H:%M:%S +0700 %Y') END AS raw FROM events)"""

_WEIGHTED = " + ".join(["0.0"] + [f"CAST({n} AS DOUBLE) * {_dbl(w)}" for n, w in S.SHIPPED_FEATURE_WEIGHTS])


def _likes_int(x: str) -> str:
    return f"coalesce(TRY_CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS INTEGER), 0)"


GAIN_ROOT = f""",
lab AS (SELECT l.id, l.sentiment AS label FROM labeled l JOIN split s ON l.id = s.id WHERE s.split_type = 'train'),
gdt AS (SELECT id, term, count(*) AS tf
        FROM (SELECT l.id, unnest({tokens_sql('l.preprocessed_text')}) AS term FROM labeled l JOIN lab ON l.id = lab.id)
        WHERE term NOT IN ({", ".join(q(w) for w in english_stop_words())})
        GROUP BY id, term),
gtop AS (SELECT term FROM (SELECT term, sum(tf) AS n FROM gdt GROUP BY term) ORDER BY n DESC, term LIMIT {C.TREE_TERMS}),
nz AS (SELECT gdt.* FROM gdt JOIN gtop ON gdt.term = gtop.term),
cnt AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
tot AS (SELECT sum(n) AS n FROM cnt),
hroot AS (SELECT -sum(cnt.n / tot.n * log2(cnt.n / tot.n)) AS h FROM cnt, tot),
c AS (SELECT nz.term, nz.tf AS v, lab.label, count(*) AS c FROM nz JOIN lab ON nz.id = lab.id GROUP BY ALL),
zs AS (SELECT term, label, sum(c) AS s FROM c GROUP BY ALL),
terms AS (SELECT DISTINCT 0 AS node, term FROM c),
zero AS (SELECT t.term, 0 AS v, k.label, k.n - coalesce(zs.s, 0) AS c
         FROM terms t JOIN (SELECT 0 AS node, label, n FROM cnt) k ON k.node = t.node
         LEFT JOIN zs ON zs.term = t.term AND zs.label = k.label),
br AS (SELECT term, v, label, c FROM c UNION ALL SELECT term, v, label, c FROM zero WHERE c > 0),
bw AS (SELECT *, sum(c) OVER (PARTITION BY term, v) AS nb FROM br),
hb AS (SELECT term, v, any_value(nb) AS nb, -sum(c / nb * log2(c / nb)) AS h FROM bw GROUP BY term, v),
g AS (SELECT term, sum(nb / tot.n * h) AS we, -sum(nb / tot.n * log2(nb / tot.n)) AS si, count(*) AS n_values
      FROM hb, tot GROUP BY term),
gr AS (SELECT term, hroot.h - we AS info_gain, si AS split_info,
              CASE WHEN si > 0 THEN (hroot.h - we) / si ELSE 0.0 END AS gain_ratio, n_values FROM g, hroot)"""



def _tree_level(k: int, last: bool) -> str:
    """CTEs of one tree level: rows a{k} (id, label, path) -> best{k} (path, feature) and, unless last, a{k+1}."""
    head = f""",
cnt{k} AS MATERIALIZED (SELECT path, label, count(*) AS n FROM a{k} GROUP BY ALL),
node{k} AS MATERIALIZED (SELECT path, sum(n) AS n, count(*) AS labels, arg_max(label, (n, -label_no)) AS majority,
                                log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h
                         FROM (SELECT *, dense_rank() OVER (ORDER BY label) AS label_no FROM cnt{k}) GROUP BY path)"""
    if last:
        return head
    return head + f""",
c{k} AS MATERIALIZED (SELECT a.path, z.term, z.tf AS v, a.label, count(*) AS c FROM a{k} a JOIN node{k} o ON a.path = o.path AND o.labels > 1
         JOIN nz z ON a.id = z.id GROUP BY ALL),
zs{k} AS (SELECT path, term, label, sum(c) AS s FROM c{k} GROUP BY ALL),
zero{k} AS (SELECT t.path, t.term, 0 AS v, n.label, n.n - coalesce(z.s, 0) AS c FROM (SELECT DISTINCT path, term FROM c{k}) t
            JOIN cnt{k} n ON n.path = t.path LEFT JOIN zs{k} z ON z.path = t.path AND z.term = t.term AND z.label = n.label),
br{k} AS (SELECT path, term, v, label, c FROM c{k} UNION ALL SELECT path, term, v, label, c FROM zero{k} WHERE c > 0),
hb{k} AS (SELECT path, term, v, sum(c) AS nb, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS hb FROM br{k} GROUP BY ALL),
g{k} AS (SELECT b.path, b.term, any_value(o.h) - sum(b.nb / o.n * b.hb) AS ig, -sum(b.nb / o.n * log2(b.nb / o.n)) AS si
         FROM hb{k} b JOIN node{k} o ON b.path = o.path GROUP BY ALL),
gr{k} AS (SELECT path, term, round(CASE WHEN si > 0 THEN ig / si ELSE 0.0 END, 12) AS gr FROM g{k}),
best{k} AS MATERIALIZED (SELECT path, term FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gr DESC, term) AS r FROM gr{k})
                         WHERE r = 1 AND abs(gr) >= 1e-12),
a{k + 1} AS MATERIALIZED (
  SELECT a.id, a.label, a.path || '/' || CASE WHEN coalesce(z.tf, 0) < 100000 THEN lpad(CAST(coalesce(z.tf, 0) AS VARCHAR), 6, '0')
                                              ELSE CAST(z.tf AS VARCHAR) END AS path
  FROM a{k} a JOIN best{k} b ON a.path = b.path LEFT JOIN nz z ON z.id = a.id AND z.term = b.term)"""


def _tree_sql(depth: int) -> str:
    """M2 with a depth limit: the levels written out one after the other, then the node table of all of them."""
    levels = "".join(_tree_level(k, k == depth) for k in range(depth + 1))
    parts = []
    for k in range(depth + 1):
        feature = "b.term" if k < depth else "CAST(NULL AS VARCHAR)"
        join = f"LEFT JOIN best{k} b ON b.path = o.path" if k < depth else ""
        parts.append(f"""SELECT o.path AS node_id, CASE WHEN o.path <> '' THEN regexp_extract(o.path, '^(.*)/[^/]*$', 1) END AS parent_id,
  CASE WHEN o.path <> '' THEN CAST(CAST(regexp_extract(o.path, '([^/]*)$', 1) AS BIGINT) AS VARCHAR) END AS split_value,
  {k} AS depth, {feature} AS feature, CASE WHEN {feature} IS NULL THEN o.majority END AS class, o.majority,
  CAST(o.n AS BIGINT) AS n, {feature} IS NULL AS is_leaf FROM node{k} o {join}""")
    matrix = GAIN_ROOT.split("\ncnt AS")[0].replace("\nnz AS (", "\nnz AS MATERIALIZED (")
    return ("WITH " + LABELED_CTE + SPLIT + matrix + "\na0 AS MATERIALIZED (SELECT id, label, '' AS path FROM lab)" + levels
            + "\n" + "\nUNION ALL\n".join(parts))


def _cart_level(k: int, last: bool) -> str:
    """CTEs of one level of the binary tree: rows b{k} (id, label, path) -> pick{k} (path, term, threshold) and b{k+1}."""
    head = f""",
bc{k} AS MATERIALIZED (SELECT path, label, count(*) AS n FROM b{k} GROUP BY ALL),
bn{k} AS MATERIALIZED (SELECT path, sum(n) AS n, count(*) AS labels, arg_max(label, (n, -label_no)) AS majority
                       FROM (SELECT *, dense_rank() OVER (ORDER BY label) AS label_no FROM bc{k}) GROUP BY path)"""
    if last:
        return head
    return head + f""",
bh{k} AS MATERIALIZED (SELECT b.path, z.term, z.tf AS v, b.label, count(*) AS c FROM b{k} b
         JOIN bn{k} o ON b.path = o.path AND o.labels > 1 AND length(o.path) = {k} JOIN nz z ON b.id = z.id GROUP BY ALL),
bv{k} AS (SELECT path, term, v, lag(v) OVER (PARTITION BY path, term ORDER BY v) AS below FROM (SELECT DISTINCT path, term, v FROM bh{k})),
br{k}x AS (SELECT v.path, v.term, v.v, any_value(v.below) AS below, h.label, sum(h.c) AS r FROM bv{k} v
           JOIN bh{k} h ON h.path = v.path AND h.term = v.term AND h.v >= v.v GROUP BY v.path, v.term, v.v, h.label),
bs{k} AS (SELECT v.path, v.term, v.v, v.below, c.label, coalesce(r.r, 0) AS r, c.n - coalesce(r.r, 0) AS l FROM bv{k} v
          JOIN bc{k} c ON c.path = v.path LEFT JOIN br{k}x r ON r.path = v.path AND r.term = v.term AND r.v = v.v AND r.label = c.label),
bg{k} AS (SELECT path, term, (v + coalesce(any_value(below), 0)) / 2.0 AS threshold, round((
            sum(l) - sum(l * l) / CAST(sum(l) AS DOUBLE) + sum(r) - sum(r * r) / CAST(sum(r) AS DOUBLE)) / (sum(l) + sum(r)), 12) AS cost
          FROM bs{k} GROUP BY path, term, v HAVING sum(l) > 0),
pick{k} AS MATERIALIZED (SELECT path, term, threshold FROM (
            SELECT *, row_number() OVER (PARTITION BY path ORDER BY cost, term, threshold) AS i FROM bg{k}) WHERE i = 1),
b{k + 1} AS MATERIALIZED (SELECT b.id, b.label, b.path || CASE WHEN p.path IS NULL THEN '' WHEN coalesce(z.tf, 0) > p.threshold THEN '1' ELSE '0' END AS path
         FROM b{k} b LEFT JOIN pick{k} p ON b.path = p.path LEFT JOIN nz z ON z.id = b.id AND z.term = p.term)"""


def _cart_sql(depth: int, body: str) -> str:
    """The binary tree to a depth, written out level by level, then ``body`` over ``cart`` and the last level's rows."""
    levels = "".join(_cart_level(k, k == depth) for k in range(depth + 1))
    parts = []
    for k in range(depth + 1):
        pick = f"LEFT JOIN pick{k} p ON p.path = o.path" if k < depth else "LEFT JOIN (SELECT '' AS path, '' AS term, 0.0 AS threshold WHERE false) p ON true"
        parts.append(f"""SELECT o.path AS node_id, CASE WHEN o.path <> '' THEN left(o.path, length(o.path) - 1) END AS parent_id, {k} AS depth,
  p.term AS feature, CAST(p.threshold AS DOUBLE) AS threshold, CASE WHEN p.term IS NULL THEN o.majority END AS class, o.majority,
  CAST(o.n AS BIGINT) AS n, p.term IS NULL AS is_leaf FROM bn{k} o {pick} WHERE length(o.path) = {k}""")
    matrix = GAIN_ROOT.split("\ncnt AS")[0].replace("\nnz AS (", "\nnz AS MATERIALIZED (")
    return ("WITH " + LABELED_CTE + SPLIT + matrix + "\nb0 AS MATERIALIZED (SELECT id, label, '' AS path FROM lab)" + levels
            + ",\ncart AS MATERIALIZED (" + "\nUNION ALL\n".join(parts) + """),
numbered AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS number FROM cart)
""" + body)


CART_RULES = """, lines AS (
SELECT n.number, 0 AS part, repeat('|   ', n.depth - 1) || '|--- ' || u.feature || CASE WHEN n.node_id LIKE '%1' THEN ' > ' ELSE ' <= ' END
       || printf('%.2f', u.threshold) AS line FROM numbered n JOIN numbered u ON n.parent_id = u.node_id
UNION ALL SELECT number, 1, repeat('|   ', depth) || '|--- class: ' || class FROM numbered WHERE is_leaf)
SELECT row_number() OVER (ORDER BY number, part) AS line_no, line FROM lines"""

CART_DOT = """, lines AS (
SELECT 0 AS part, 0 AS place, 'digraph Tree {' AS line UNION ALL SELECT 3, 0, '}'
UNION ALL SELECT 1, number, number || ' [label="' || CASE WHEN is_leaf THEN 'class = ' || class ELSE feature || ' <= ' || printf('%.2f', threshold) END
       || chr(92) || 'nsamples = ' || n || '"] ;' FROM numbered
UNION ALL SELECT 2, n.number, u.number || ' -> ' || n.number || ' ;' FROM numbered n JOIN numbered u ON n.parent_id = u.node_id)
SELECT row_number() OVER (ORDER BY part, place) AS line_no, line FROM lines"""


def shape_sql(w: str) -> str:
    """Letters of a word as c (consonant) or v (vowel); y is a vowel after a consonant."""
    return (f"list_reduce(string_split({w}, ''), lambda a, c: a || CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR c = 'y' AND suffix(a, 'c') "
            "THEN 'v' ELSE 'c' END, '')")


def _stem_steps() -> str:
    """Porter stemming of the distinct words ``d(word)`` as a chain of CTEs that ends in ``stems(word, stem)``."""
    def measure(shape: str) -> str:
        return f"len(regexp_extract_all({shape}, 'v+c'))"

    def left(n: str, col: str = "w") -> str:
        return f"left({col}, length(w) - {n})"

    def first(suffixes) -> str:
        return "CASE " + " ".join(f"WHEN suffix(w, '{x}') THEN '{x}'" for x in suffixes) + " ELSE '' END"

    def shaped(name: str, source: str, w: str, more: str = "") -> str:
        return f"{name} AS (SELECT *, {shape_sql('w')} AS s FROM (SELECT word, {w} AS w{more} FROM {source}))"

    def swap(rules) -> str:
        new = "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules) + " END"
        return f"CASE WHEN e <> '' AND {measure(left('length(e)', 's'))} > 0 THEN {left('length(e)')} || {new} ELSE w END"

    ends = "SELECT *, {} AS e FROM {}"
    short = left("1", "s")
    return ",\n".join([
        shaped("s0", "d", "CASE WHEN suffix(word, 'sses') OR suffix(word, 'ies') THEN left(word, length(word) - 2) WHEN suffix(word, 'ss') "
               "THEN word WHEN suffix(word, 's') THEN left(word, length(word) - 1) ELSE word END"),
        f"""c1 AS (SELECT *, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {measure(left('3', 's'))} > 0 THEN 1 ELSE 0 END
               WHEN suffix(w, 'ed') AND contains({left('2', 's')}, 'v') THEN 2
               WHEN suffix(w, 'ing') AND contains({left('3', 's')}, 'v') THEN 3 ELSE 0 END AS cut FROM s0)""",
        shaped("s1", "c1", "left(w, length(w) - cut)", ", cut"),
        shaped("s2", "s1", f"""CASE WHEN cut < 2 THEN w WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e'
               WHEN length(w) >= 2 AND w[-1] = w[-2] AND suffix(s, 'c') AND w[-1] NOT IN ('l', 's', 'z') THEN {left('1')}
               WHEN {measure('s')} = 1 AND suffix(s, 'cvc') AND w[-1] NOT IN ('w', 'x', 'y') THEN w || 'e' ELSE w END"""),
        shaped("s3", "s2", f"CASE WHEN suffix(w, 'y') AND contains({short}, 'v') THEN {left('1')} || 'i' ELSE w END"),
        shaped("s4", f"({ends.format(first([a for a, _ in STEP2]), 's3')})", swap(STEP2)),
        shaped("s5", f"({ends.format(first([a for a, _ in STEP3]), 's4')})", swap(STEP3)),
        shaped("s6", f"({ends.format(first(STEP4), 's5')})", f"""CASE WHEN e <> '' AND {measure(left('length(e)', 's'))} > 1
               AND (e <> 'ion' OR {left('length(e)')}[-1] IN ('s', 't')) THEN {left('length(e)')} ELSE w END"""),
        shaped("s7", "s6", f"""CASE WHEN suffix(w, 'e') AND ({measure(short)} > 1 OR {measure(short)} = 1
               AND NOT (suffix({short}, 'cvc') AND w[-2] NOT IN ('w', 'x', 'y'))) THEN {left('1')} ELSE w END"""),
        f"""stems AS (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN {measure('s')} > 1 AND suffix(w, 'll') THEN {left('1')}
               ELSE w END AS stem FROM s7)"""])


SQL = {
    # clean
    "clean_text": f"""SELECT 'documents' AS kind, doc_id AS id, {clean_sql('text')} AS preprocessed_text FROM documents
        UNION ALL SELECT 'pages' AS kind, page_id AS id, {clean_sql('html')} AS preprocessed_text FROM pages""",
    "tokenize": f"""WITH {CLEAN_DOCS}, tk AS (SELECT id, t, {tokens_sql('t')} AS tok FROM cd)
        SELECT id, len({words_sql('t')}) AS n_words, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct,
               array_to_string(tok, ' ') AS tokens FROM tk""",
    "remove_stopwords": f"""WITH {CLEAN_DOCS},
        w AS (SELECT unnest({words_sql('t')}) AS word FROM cd),
        top AS (SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT {C.STOPWORD_TOP}),
        stop AS (SELECT list(word) AS sw FROM top)
        SELECT id, array_to_string(list_filter({words_sql('t')}, lambda x: NOT list_contains(stop.sw, x)), ' ') AS text_nostop
        FROM cd, stop""",
    # score
    "softmax_classify": "WITH " + LABELED_CTE.split(",\nlabeled AS")[0] + """
        SELECT id, sentiment, confidence, round(probs[1], 6) AS p_negative, round(probs[2], 6) AS p_neutral,
               round(probs[3], 6) AS p_positive FROM scored""",
    "label_posts": "WITH " + LABELED_CTE + f"""
        SELECT id, preprocessed_text, sentiment, confidence, coalesce(favorite_count, 0) AS favorite_count,
               {_tier_case('confidence')} AS confidence_level, CAST(NULL AS VARCHAR) AS sentiment_category,
               {_popularity_case()} AS popularity
        FROM labeled WHERE text IS NOT NULL AND text <> ''""",
    "python_scorer": "WITH " + LABELED_CTE + f""",
        lx AS (SELECT id, {words_sql('preprocessed_text')} AS w FROM labeled),
        lg AS (SELECT id, [CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.NEGATIVE_WORDS)}))) AS DOUBLE),
                           1.0,
                           CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.POSITIVE_WORDS)}))) AS DOUBLE)]
                   AS logits FROM lx),
        ex AS (SELECT id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM lg),
        pr AS (SELECT id, list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) AS probs FROM ex)
        SELECT id, (['negative','neutral','positive'])[list_position(probs, list_max(probs))] AS sentiment,
               round(list_max(probs), 6) AS confidence, CAST(NULL AS VARCHAR) AS _error FROM pr""",
    "label_csv": "WITH " + LABELED_CTE + f""",
        lx AS (SELECT id, {words_sql('preprocessed_text')} AS w FROM labeled WHERE text IS NOT NULL AND text <> ''),
        lg AS (SELECT id, [CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.NEGATIVE_WORDS)}))) AS DOUBLE),
                           1.0,
                           CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.POSITIVE_WORDS)}))) AS DOUBLE)]
                   AS logits FROM lx),
        ex AS (SELECT id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM lg),
        pr AS (SELECT id, list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) AS probs FROM ex)
        , sc AS (SELECT id, (['negative','neutral','positive'])[list_position(probs, list_max(probs))] AS sentiment,
               round(list_max(probs), 6) AS confidence FROM pr)
        SELECT sc.id, sc.sentiment, sc.confidence, coalesce(l.favorite_count, 0) AS favorite_count,
               {_tier_case('sc.confidence')} AS confidence_level,
               {_popularity_case_on('coalesce(l.favorite_count, 0)', 'sc.sentiment')} AS popularity
        FROM sc JOIN labeled l ON l.id = sc.id""",
    "stream_label_csv": "WITH " + LABELED_CTE + f""",
        lx AS (SELECT id, {words_sql('preprocessed_text')} AS w FROM labeled WHERE text IS NOT NULL AND text <> ''),
        lg AS (SELECT id, [CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.NEGATIVE_WORDS)}))) AS DOUBLE),
                           1.0,
                           CAST(len(list_filter(w, lambda x: x IN ({", ".join(q(x) for x in C.POSITIVE_WORDS)}))) AS DOUBLE)]
                   AS logits FROM lx),
        ex AS (SELECT id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM lg),
        pr AS (SELECT id, list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) AS probs FROM ex)
        , sc AS (SELECT id, (['negative','neutral','positive'])[list_position(probs, list_max(probs))] AS sentiment,
               round(list_max(probs), 6) AS confidence FROM pr)
        SELECT l.username, sc.sentiment, sc.confidence, coalesce(l.favorite_count, 0) AS favorite_count
        FROM sc JOIN labeled l ON l.id = sc.id""",
    "feature_score": "WITH " + LABELED_CTE + FEATURES + f"""
        SELECT id, kata_positif, kata_negatif, jumlah_tanda_seru, jumlah_kata, round({_WEIGHTED}, 6) AS score
        FROM feat""",
    "path_rules": "WITH " + LABELED_CTE + FEATURES + """
        SELECT id, kata_positif, CASE WHEN CAST(kata_positif AS DOUBLE) <= 1.0 THEN 'negative'
                                      WHEN CAST(kata_positif AS DOUBLE) > 1.0 THEN 'positive' END AS path_label,
               CASE WHEN CAST(kata_positif AS DOUBLE) <= 1.0 THEN 1 WHEN CAST(kata_positif AS DOUBLE) > 1.0 THEN 2 END AS node_id
        FROM feat""",
    # ingest
    "scan_posts": "WITH " + LABELED_CTE + """
        SELECT id, text AS full_text, coalesce(favorite_count, 0) AS favorite_count,
               strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, location, username FROM labeled""",
    "scorable_posts": "WITH " + LABELED_CTE + """
        SELECT id, sentiment, confidence FROM labeled WHERE preprocessed_text IS NOT NULL AND preprocessed_text <> ''""",
    "missing_columns": "WITH " + LABELED_CTE + """,
        a AS (SELECT count(*) AS n_rows, count(favorite_count) AS f0, count(created_at) AS f1, count(location) AS f2,
                     count(username) AS f3 FROM labeled)
        SELECT 0 AS ordinal, 'favorite_count' AS column_name, f0 AS n_filled, n_rows, true AS present, f0 = 0 AS missing FROM a
        UNION ALL SELECT 1, 'created_at', f1, n_rows, true, f1 = 0 FROM a
        UNION ALL SELECT 2, 'location', f2, n_rows, true, f2 = 0 FROM a
        UNION ALL SELECT 3, 'username', f3, n_rows, true, f3 = 0 FROM a""",
    "preview_rows": "WITH " + LABELED_CTE + f"""
        SELECT id, coalesce(text, '') AS full_text, coalesce(CAST(favorite_count AS VARCHAR), '') AS favorite_count,
               coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '') AS created_at, coalesce(location, '') AS location,
               coalesce(username, '') AS username, (SELECT count(*) FROM labeled) AS total_rows
        FROM labeled ORDER BY id LIMIT {C.PREVIEW_ROWS}""",
    "parse_created_at": f"""WITH {_RAW_DATES}
        SELECT event_id, raw, strftime({_PARSED}, '%Y-%m-%d %H:%M:%S') AS created_at FROM raw""",
    "import_defaults": "WITH " + LABELED_CTE + f""",
        x AS (SELECT *, CASE WHEN location = 'view' THEN CAST(favorite_count AS VARCHAR) || '.0'
                             ELSE CAST(favorite_count AS VARCHAR) END AS likes_text FROM labeled)
        SELECT id, coalesce(text, '') AS text, coalesce(preprocessed_text, '') AS preprocessed_text,
               coalesce(source_dataset, 'imported') AS source_dataset, coalesce(sentiment, 'neutral') AS sentiment,
               coalesce(confidence, 0.0) AS confidence, {_likes_int('likes_text')} AS favorite_count, location, username
        FROM x""",
    "union_tagged": "WITH " + LABELED_CTE.split(",\nlabeled AS")[0] + f"""
        SELECT id, CASE WHEN lang = 'en' THEN 'data_latih_1' ELSE 'data_latih_2' END AS source_dataset,
               {clean_sql('text')} AS preprocessed_text, sentiment, confidence FROM scored""",
    # rules
    "confidence_tier": "WITH " + LABELED_CTE + f"""
        SELECT id, confidence, {_tier_case('confidence')} AS confidence_level FROM labeled""",
    "sentiment_category": "WITH " + LABELED_CTE + f"""
        SELECT id, sentiment, confidence, {_category_case()} AS sentiment_category FROM labeled""",
    "popularity": "WITH " + LABELED_CTE + f"""
        SELECT id, sentiment, coalesce(favorite_count, 0) AS favorite_count, {_popularity_case()} AS popularity
        FROM labeled""",
    "rules_nested": "WITH " + LABELED_CTE + f"""
        SELECT id, {_category_case()} AS sentiment_category,
               CASE WHEN coalesce(favorite_count, 0) >= 500 THEN CASE sentiment
                        WHEN 'positive' THEN '{S.VIRAL_LABELS["positive"]}' WHEN 'negative' THEN '{S.VIRAL_LABELS["negative"]}'
                        WHEN 'neutral' THEN '{S.VIRAL_LABELS["neutral"]}' END
                    WHEN coalesce(favorite_count, 0) >= 50 THEN '{S.POPULAR_LABEL}' ELSE '{S.NORMAL_LABEL}' END AS popularity
        FROM labeled""",
    "import_append": """
        SELECT 2 * count(*) AS n_rows, 2 * count(*) AS n_ids, CAST(1 AS BIGINT) AS min_id, 2 * count(*) AS max_id FROM documents""",
    "mixed_encodings": "SELECT doc_id AS id, md5(text) AS text_md5 FROM documents",
    "confidence_patterns": "WITH " + LABELED_CTE + """
        SELECT sentiment, floor(confidence * 10) / 10 AS conf_range, count(*) AS n, min(id) AS first_seen
        FROM labeled GROUP BY sentiment, floor(confidence * 10) / 10""",
    "likes_patterns": "WITH " + LABELED_CTE + """
        SELECT sentiment, CASE WHEN coalesce(favorite_count, 0) >= 1000 THEN 'high'
                               WHEN coalesce(favorite_count, 0) >= 100 THEN 'medium' ELSE 'low' END AS like_range,
               count(*) AS n, min(id) AS first_seen
        FROM labeled GROUP BY ALL""",
    "mine_confidence_rules": "WITH " + LABELED_CTE + MINED + " SELECT * FROM mined",
    "rules_text": "WITH " + LABELED_CTE + MINED + """,
        types AS (SELECT * FROM (VALUES (1, 'confidence_rules'), (2, 'sentiment_classification'),
                                        (3, 'popularity_rules'), (4, 'impact_rules')) v(type_ord, rule_type)),
        lines AS (SELECT type_ord, 0 AS ordinal, chr(10) || 'KATEGORI: ' || upper(rule_type) AS line FROM types
                  UNION ALL
                  SELECT t.type_ord, m.ordinal, 'JIKA ' || CASE WHEN m.threshold IS NOT NULL
                         THEN 'confidence >= ' || CAST(m.threshold AS VARCHAR) ELSE '' END || ' MAKA ' || m.label
                  FROM mined m JOIN types t ON m.rule_type = t.rule_type)
        SELECT CAST(row_number() OVER (ORDER BY type_ord, ordinal) AS INTEGER) AS line_no, line FROM lines""",
    "rules_roundtrip": "WITH " + LABELED_CTE + MINED + """
        SELECT rule_type, rule_name, ordinal,
               to_json({'threshold': threshold, 'count': count, 'label': label}) :: VARCHAR AS rule_data,
               threshold, count, label FROM mined""",
    "rules_edges": "WITH " + LABELED_CTE + MINED + """
        SELECT rule_type AS category, 'input' AS src, rule_name AS dst, '>= ' || CAST(threshold AS VARCHAR) AS edge_label,
               label AS node_label FROM mined""",
    # stats
    "sentiment_counts": "WITH " + BASE_CTE + " SELECT sentiment, count(*) AS n FROM sentiments GROUP BY sentiment",
    "dataset_counts": "WITH " + BASE_CTE + " SELECT source_dataset, count(*) AS n FROM texts GROUP BY source_dataset",
    "sentiment_stats": "WITH " + BASE_CTE + """
        SELECT (SELECT count(*) FROM texts) AS total, (SELECT round(sum(CAST(round(confidence * 1000000) AS BIGINT)) / count(confidence)) / 1000000.0 FROM sentiments) AS avg_confidence,
               round((SELECT avg(favorite_count) FROM metadata), 6) AS avg_favorite_count""",
    "stats_grouping_sets": "WITH " + LABELED_CTE + """
        SELECT sentiment, source_dataset, CAST(grouping(sentiment, source_dataset) AS INTEGER) AS gid, count(*) AS n,
               round(sum(CAST(round(confidence * 1000000) AS BIGINT)) / count(confidence)) / 1000000.0 AS avg_confidence
        FROM labeled GROUP BY GROUPING SETS ((sentiment), (source_dataset), ())""",
    "dashboard_stats": "WITH " + LABELED_CTE + """
        SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'negative') AS n_negative,
               count(*) FILTER (WHERE sentiment = 'neutral') AS n_neutral,
               count(*) FILTER (WHERE sentiment = 'positive') AS n_positive,
               round(sum(CAST(round(confidence * 1000000) AS BIGINT)) / count(confidence)) / 1000000.0 AS avg_confidence, round(avg(favorite_count), 6) AS avg_likes FROM labeled""",
    "sentiment_distribution": "WITH " + LABELED_CTE + f""",
        c AS (SELECT sentiment, count(*) AS n FROM labeled GROUP BY sentiment),
        j AS (SELECT dom.sentiment, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {DOMAIN} LEFT JOIN c ON dom.sentiment = c.sentiment)
        SELECT sentiment, n, round(CASE WHEN sum(n) OVER () > 0 THEN n * 100.0 / sum(n) OVER () ELSE 0.0 END, 6) AS pct,
               CAST(sum(n) OVER () AS BIGINT) AS total FROM j""",
    "confidence_histogram": "WITH " + LABELED_CTE + f""",
        mm AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM labeled),
        b AS (SELECT CASE WHEN hi - lo > 0 THEN least(CAST(floor((confidence - lo) / (hi - lo) * {S.HISTOGRAM_BINS}) AS INTEGER) + 1, {S.HISTOGRAM_BINS})
                          ELSE 1 END AS bucket FROM labeled, mm WHERE confidence IS NOT NULL)
        SELECT bucket, count(*) AS n, round(lo + (bucket - 1) * (hi - lo) / {S.HISTOGRAM_BINS}, 6) AS lo,
               round(lo + bucket * (hi - lo) / {S.HISTOGRAM_BINS}, 6) AS hi
        FROM b, mm GROUP BY bucket, mm.lo, mm.hi""",
    "likes_boxplot": "WITH " + LABELED_CTE + """,
        g AS (SELECT sentiment, count(*) AS n, CAST(min(favorite_count) AS DOUBLE) AS min,
                     quantile_cont(favorite_count, 0.25) AS q1, quantile_cont(favorite_count, 0.5) AS median,
                     quantile_cont(favorite_count, 0.75) AS q3, CAST(max(favorite_count) AS DOUBLE) AS max
              FROM labeled WHERE favorite_count IS NOT NULL GROUP BY sentiment)
        SELECT sentiment, n, min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, max,
               round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence FROM g""",
    "distinct_labels": "WITH " + LABELED_CTE + " SELECT DISTINCT sentiment FROM labeled",
    # store
    "labeled_view": "WITH " + BASE_CTE + VIEW + " SELECT * FROM view",
    "labeled_limit": "WITH " + BASE_CTE + VIEW + f" SELECT * FROM view ORDER BY id LIMIT {C.LIMIT_ROWS}",
    "filter_by_sentiment": "WITH " + BASE_CTE + VIEW + " SELECT * FROM view WHERE sentiment = 'positive'",
    "normalize_texts": "WITH " + LABELED_CTE + """
        SELECT row_number() OVER (ORDER BY id) AS id, text, preprocessed_text, created_at, source_dataset FROM labeled""",
    "normalize_sentiments": "WITH " + LABELED_CTE + """
        SELECT row_number() OVER (ORDER BY id) AS id, row_number() OVER (ORDER BY id) AS text_id, sentiment, confidence
        FROM labeled""",
    "normalize_metadata": "WITH " + LABELED_CTE + """,
        x AS (SELECT *, row_number() OVER (ORDER BY id) AS tid FROM labeled)
        SELECT tid AS id, tid AS text_id, coalesce(favorite_count, 0) AS favorite_count, location, username
        FROM x WHERE has_metadata""",
    # split
    "train_test_split": "WITH " + LABELED_CTE + SPLIT + " SELECT id, split_type FROM split",
    "split_preview": "WITH " + LABELED_CTE + f""",
        c AS (SELECT count(*) AS total_rows FROM labeled),
        r AS (SELECT total_rows, CAST(round_even(total_rows * {C.TRAIN_PERCENT} / 100.0, 0) AS BIGINT) AS train_rows FROM c)
        SELECT total_rows, train_rows, total_rows - train_rows AS test_rows,
               round(CASE WHEN total_rows > 0 THEN train_rows / total_rows * 100 ELSE 0.0 END, 6) AS train_percent,
               round(CASE WHEN total_rows > 0 THEN (total_rows - train_rows) / total_rows * 100 ELSE 0.0 END, 6) AS test_percent
        FROM r""",
    "dataset_splits": "WITH " + LABELED_CTE + SPLIT + " SELECT id AS text_id, split_type FROM split",
    "split_join_train": "WITH " + BASE_CTE + VIEW + SPLIT + """
        SELECT v.*, s.split_type FROM view v JOIN split s ON v.id = s.id WHERE s.split_type = 'train'""",
    "split_join_test": "WITH " + BASE_CTE + VIEW + SPLIT + """
        SELECT v.*, s.split_type FROM view v JOIN split s ON v.id = s.id WHERE s.split_type = 'test'""",
    "split_summary": "WITH " + BASE_CTE + SPLIT + """
        SELECT (SELECT count(*) FROM texts) AS total_data,
               (SELECT count(*) FROM split WHERE split_type = 'train') AS train_data,
               (SELECT count(*) FROM split WHERE split_type = 'test') AS test_data""",
    "data_distribution": "WITH " + BASE_CTE + SPLIT + """,
        s AS (SELECT (SELECT count(*) FROM texts) AS total_data,
                     (SELECT count(*) FROM split WHERE split_type = 'train') AS tr,
                     (SELECT count(*) FROM split WHERE split_type = 'test') AS te)
        SELECT total_data, tr AS train_size, te AS test_size,
               CASE WHEN total_data > 0 THEN round_even(tr * 100.0 / total_data, 1) ELSE 0.0 END AS train_percent,
               CASE WHEN total_data > 0 THEN round_even(te * 100.0 / total_data, 1) ELSE 0.0 END AS test_percent
        FROM s""",
    "test_distribution": "WITH " + LABELED_CTE + SPLIT + f""",
        c AS (SELECT l.sentiment, count(*) AS n FROM labeled l JOIN split s ON l.id = s.id
              WHERE s.split_type = 'test' GROUP BY l.sentiment),
        j AS (SELECT dom.sentiment, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {DOMAIN} LEFT JOIN c ON dom.sentiment = c.sentiment)
        SELECT sentiment, n, CAST(sum(n) OVER () AS BIGINT) AS total,
               CASE WHEN sum(n) OVER () > 0 THEN round_even(n * 100.0 / sum(n) OVER (), 1) ELSE 0.0 END AS pct FROM j""",
    "batch_progress": "WITH " + LABELED_CTE + """,
        x AS (SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS row_idx, count(*) OVER () AS total_rows FROM labeled),
        y AS (SELECT *, CAST(least(50, greatest(10, floor(total_rows / 20))) AS BIGINT) AS batch_size FROM x),
        g AS (SELECT CAST(floor(row_idx / batch_size) AS BIGINT) AS batch, count(*) AS n_rows,
                     count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS n_saved, any_value(batch_size) AS batch_size,
                     any_value(total_rows) AS total_rows FROM y GROUP BY 1)
        SELECT batch, n_rows, n_saved, n_rows - n_saved AS n_skipped, least(batch * batch_size + batch_size, total_rows) AS done,
               CAST(floor(batch * batch_size / total_rows * 80) AS INTEGER) AS progress FROM g""",
    # features
    "top_terms": "WITH " + DOC_TERMS + " SELECT * FROM vocab",
    "term_counts": "WITH " + DOC_TERMS + " SELECT * FROM tv",
    "tfidf": "WITH " + DOC_TERMS + """,
        nd AS (SELECT count(*) AS n FROM documents),
        vdf AS (SELECT term, count(*) AS df FROM tv GROUP BY term),
        w AS (SELECT tv.id, tv.term, tv.idx, tv.tf, tv.tf * (ln((1.0 + nd.n) / (1.0 + vdf.df)) + 1.0) AS w
              FROM tv JOIN vdf ON tv.term = vdf.term, nd)
        SELECT id, term, idx, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS tfidf FROM w""",
    "lemma_lookup": f"""WITH {CLEAN_DOCS},
        lem AS (SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in C.LEMMAS)}) v(token, lemma)),
        w AS (SELECT id, unnest({words_sql('t')}) AS token, generate_subscripts({words_sql('t')}, 1) AS pos FROM cd),
        r AS (SELECT w.id, string_agg(coalesce(lem.lemma, w.token), ' ' ORDER BY w.pos) AS lemmatized
              FROM w LEFT JOIN lem ON w.token = lem.token GROUP BY w.id)
        SELECT cd.id, coalesce(r.lemmatized, '') AS lemmatized FROM cd LEFT JOIN r ON cd.id = r.id""",
    "csv_split_records": """SELECT doc_id AS id, replace(text, '. ', '."' || chr(10)) AS full_text, false AS too_long FROM documents""",
    "stem_text": f"""WITH {CLEAN_DOCS},
        wd AS (SELECT id, unnest({words_sql('t')}) AS word, generate_subscripts({words_sql('t')}, 1) AS pos FROM cd),
        d AS (SELECT DISTINCT word FROM wd),
        {_stem_steps()},
        r AS (SELECT wd.id, string_agg(stems.stem, ' ' ORDER BY wd.pos) AS stemmed FROM wd JOIN stems ON wd.word = stems.word GROUP BY wd.id)
        SELECT cd.id, coalesce(r.stemmed, '') AS stemmed FROM cd LEFT JOIN r ON cd.id = r.id""",
    # evaluate
    "confusion_matrix": "WITH " + BASE_CTE + PRED + " SELECT * FROM cm",
    "classification_report": "WITH " + BASE_CTE + PRED + """,
        pc AS (SELECT a.actual AS cls, (SELECT n FROM cm WHERE cm.actual = a.actual AND cm.predicted = a.actual) AS tp,
                      sum(n) AS support FROM cm a GROUP BY a.actual),
        pp AS (SELECT predicted AS cls, sum(n) AS pred_n FROM cm GROUP BY predicted),
        x AS (SELECT pc.cls, CASE WHEN pp.pred_n > 0 THEN pc.tp / pp.pred_n ELSE 0.0 END AS precision,
                     CASE WHEN pc.support > 0 THEN pc.tp / pc.support ELSE 0.0 END AS recall, pc.support, pc.tp
              FROM pc JOIN pp ON pc.cls = pp.cls),
        y AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM x),
        u AS (SELECT cls, precision, recall, f1, CAST(support AS BIGINT) AS support FROM y
              UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM y
              UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                               sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM y
              UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM y)
        SELECT cls AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""",
    "gain_ratio_root": "WITH " + LABELED_CTE + SPLIT + GAIN_ROOT + """
        SELECT term, round(info_gain, 9) AS info_gain, round(split_info, 9) AS split_info,
               round(gain_ratio, 9) AS gain_ratio, n_values FROM gr""",
    "tree_levels": _tree_sql(C.TREE_LEVELS),
    "threshold_tree_levels": _cart_sql(C.TREE_LEVELS, "SELECT * FROM cart"),
    "threshold_tree_predict": _cart_sql(C.TREE_LEVELS, f"""SELECT b.id, c.class AS predicted, b.path AS node_id
        FROM b{C.TREE_LEVELS} b JOIN cart c ON b.path = c.node_id"""),
    "threshold_tree_rules": _cart_sql(C.TREE_LEVELS, CART_RULES),
    "threshold_tree_dot": _cart_sql(C.TREE_LEVELS, CART_DOT),
    "gain_ratio_best": "WITH " + LABELED_CTE + SPLIT + GAIN_ROOT + """
        SELECT term, round(gain_ratio, 9) AS gain_ratio FROM gr ORDER BY round(gain_ratio, 12) DESC, term LIMIT 1""",
    "accuracy": "WITH " + BASE_CTE + PRED + """
        SELECT count(*) AS n, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pt""",
    # stream (the streams read the same documents as files; results equal the batch plan)
    "stream_sentiment_counts": "WITH " + LABELED_CTE + """
        SELECT sentiment, count(*) AS n, round(sum(CAST(round(confidence * 1000000) AS BIGINT)) / count(confidence)) / 1000000.0 AS avg_confidence FROM labeled GROUP BY sentiment""",
    "stream_label_posts": "WITH " + LABELED_CTE + f"""
        SELECT id, sentiment, confidence, {_tier_case('confidence')} AS confidence_level
        FROM labeled WHERE text IS NOT NULL AND text <> ''""",
    "stream_progress_totals": "WITH " + LABELED_CTE + """
        SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count_if(text IS NOT NULL AND text <> '') AS BIGINT) AS saved,
               CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS skipped, CAST(count(*) AS BIGINT) AS done,
               100.0 AS percent FROM labeled""",
}
