"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from textyard.functions.stopwords import ENGLISH
from textyard.plans.queries import CAP_PER_SOURCE, INSULT, KNOWN_MIN_COUNT, PAGE_SPAN, REVIEW_TARGET, RULES

STOP = ", ".join(f"'{w}'" for w in ENGLISH)
LABELLED = (
    "docs AS (SELECT d.doc_id, d.text, d.source, d.n_chars, l.toxic AS label, l.quality "
    "FROM documents d JOIN labels l USING (doc_id))"
)
URL = r"https?://\S+|www\.\S+"
KEY = "md5(doc_id || ':42')"


def _int(text: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def _rounded(value: str, digits: int = 4) -> str:
    """Rounded, with minus zero as zero."""
    return f"CASE WHEN round({value}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({value}, {digits}) END"


def _tokens(source: str = "documents", name: str = "toks") -> str:
    """The cleaner step by step."""
    return rf"""
{name}_1 AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '{URL}', ' ', 'g') AS t FROM {source}),
{name}_2 AS (SELECT doc_id, regexp_replace(t, '<[^>]+>', ' ', 'g') AS t FROM {name}_1),
{name}_3 AS (SELECT doc_id, regexp_replace(t, '[^a-z0-9\s]', ' ', 'g') AS t FROM {name}_2),
{name}_4 AS (SELECT doc_id, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') AS w FROM {name}_3),
{name}_5 AS (SELECT doc_id, list_filter(w, lambda x: length(x) > 1) AS words FROM {name}_4),
{name} AS (SELECT doc_id, words, list_filter(words, lambda x: x NOT IN ({STOP})) AS tokens FROM {name}_5)"""


GRAMS = """
grams AS (SELECT doc_id, list_concat(tokens, list_transform(range(1, len(tokens)),
  lambda i: tokens[i] || ' ' || tokens[i + 1])) AS g FROM toks),
terms AS (SELECT doc_id, unnest(g) AS term FROM grams),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM terms GROUP BY term)"""


def _vocabulary(min_df: int) -> str:
    return f"""
top AS (SELECT * FROM stats WHERE df >= {min_df} ORDER BY tf DESC, term LIMIT 10000),
vocab AS (SELECT term, tf, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM top)"""


WORDS = "words AS (SELECT doc_id, unnest(tokens) AS word FROM toks)"
KNOWN = f"""
frequent AS (SELECT word, {_int('word')} % (SELECT count(*) FROM embeddings) AS vec_id
  FROM words GROUP BY word HAVING count(*) >= {KNOWN_MIN_COUNT}),
known AS (SELECT f.word, f.vec_id, e.embedding AS vector FROM frequent f JOIN embeddings e USING (vec_id)),
counts AS (SELECT doc_id, word, count(*) AS cnt FROM words GROUP BY doc_id, word)"""

PREDICTED = rf"""
pred AS (SELECT doc_id, label, CASE WHEN regexp_matches(lower(text), '\b(idiot|moron|stupid)')
  OR {_int("doc_id || ':noise'", 1)} = 0 THEN 1 ELSE 0 END AS prediction FROM docs)"""


DIMS, SCALE = 100, 65536
_near = " UNION ALL ".join(
    f"SELECT unnest(list_transform(range(1, len(tokens) - {d} + 1), lambda i: {{'x': tokens[i], 'y': tokens[i + {d}]}}), recursive := true) FROM toks WHERE len(tokens) > {d}"
    for d in range(1, 6)
)
PAIRS = f"""
vocab AS (SELECT word FROM words GROUP BY word HAVING count(*) >= 2),
pairs AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM ({_near})
  WHERE x IN (SELECT word FROM vocab) AND y IN (SELECT word FROM vocab) GROUP BY ALL)"""
PMI = """
seen AS (SELECT word, sum(n)::DOUBLE AS m FROM (SELECT a AS word, n FROM pairs UNION ALL SELECT b, n FROM pairs) GROUP BY word),
total AS (SELECT sum(m) AS t FROM seen),
pmi AS (SELECT a, b, n, ln((n * CASE WHEN a = b THEN 2 ELSE 1 END)::DOUBLE * t / (x.m * y.m)) AS pmi
  FROM pairs JOIN seen x ON x.word = a JOIN seen y ON y.word = b, total)"""
_signs = ", ".join(f"2 * sum(CASE WHEN (b{d // 60} >> {d % 60}) & 1 = 1 THEN q ELSE 0 END) - sum(q)" for d in range(DIMS))
VECTORS = f"""
bits AS (SELECT word, {_int("word || ':42:0'")} AS b0, {_int("word || ':42:1'")} AS b1 FROM vocab),
sides AS (SELECT a AS word, b AS context, CAST(round(pmi * {SCALE}) AS BIGINT) AS q FROM pmi WHERE pmi > 0
  UNION ALL SELECT b, a, CAST(round(pmi * {SCALE}) AS BIGINT) FROM pmi WHERE pmi > 0 AND a <> b),
sums AS (SELECT sides.word, list_transform([{_signs}], lambda x: CAST(x AS DOUBLE) / ({SCALE} * sqrt({DIMS}))) AS v
  FROM sides JOIN bits ON bits.word = context GROUP BY sides.word),
vectors AS (SELECT vocab.word, coalesce(v, list_transform(range({DIMS}), lambda i: CAST(0 AS DOUBLE))) AS v FROM vocab LEFT JOIN sums USING (word))"""


def _mean(weight: str, vector: str = "v") -> str:
    """The weighted mean of vectors in a group."""
    return "[" + ", ".join(f"sum({weight} * {vector}[{d}]) / sum({weight})" for d in range(1, DIMS + 1)) + "]"


def _digest(key: str, source: str) -> str:
    return f"""SELECT {key}, len(v) AS n_dims, {_rounded('sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS norm, {_rounded('v[1]')} AS first,
  {_rounded('v[-1]')} AS last, {_rounded('list_sum(v)')} AS total, {_rounded('list_sum(list_transform(v, lambda x, i: x * i))')} AS ramp FROM {source}"""


def _subwords(char_grams: str) -> str:
    """Bucket vectors of the vocabulary's n-grams, and the vector ``v`` of every word of the documents."""
    return f"""
distinct_words AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM words),
pieces AS (SELECT word, {_int('gram')} % 2000000 AS bucket FROM (SELECT word, unnest(flatten([{char_grams}])) AS gram FROM distinct_words)),
buckets AS (SELECT bucket, {_mean('1')} AS v FROM pieces JOIN vectors USING (word) GROUP BY bucket),
parts AS (SELECT word, v::FLOAT[]::DOUBLE[] AS v FROM pieces JOIN buckets USING (bucket) UNION ALL SELECT word, v::FLOAT[]::DOUBLE[] FROM vectors),
met AS (SELECT word, {_mean('1')}::FLOAT[]::DOUBLE[] AS v FROM parts GROUP BY word),
built AS (SELECT word, coalesce(v, list_transform(range({DIMS}), lambda i: CAST(0 AS DOUBLE))) AS v FROM distinct_words LEFT JOIN met USING (word))"""


def _axes(toks: str) -> str:
    """CTEs up to ``axes`` (component, variance, axis) and ``centred`` (doc_id, label, list) of the equal-class subset."""
    dot = "list_dot_product"

    def power(name: str, source: str) -> str:
        return f"""
{name}_p AS (SELECT 0 AS step, m FROM {source} UNION ALL
  SELECT step + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / top))
  FROM (SELECT step, s, list_max(list_transform(s, lambda r: list_max(list_transform(r, lambda x: abs(x))))) AS top
    FROM (SELECT step, list_transform(m, lambda r: list_transform(m, lambda c: {dot}(r, c))) AS s FROM {name}_p WHERE step < 12))),
{name}_d AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}_p WHERE step = 12),
{name}_c AS (SELECT m[list_position(d, list_max(d))] AS v FROM {name}_d),
{name}_a AS (SELECT list_transform(v, lambda x: x / sqrt({dot}(v, v))) AS axis FROM {name}_c),
{name} AS (SELECT axis, m, {dot}(list_transform(m, lambda r: {dot}(r, axis)), axis) AS variance FROM {name}_a, {source})"""

    return f"""WITH RECURSIVE {LABELLED}, {toks}, {WORDS}, {KNOWN},
sizes AS (SELECT min(c) AS smallest FROM (SELECT count(*) AS c FROM docs GROUP BY label)),
subset AS (SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rn FROM docs)
  WHERE rn <= (SELECT smallest FROM sizes)),
width AS (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i),
means AS (SELECT doc_id, i, sum(cnt * CAST(vector[i] AS DOUBLE)) / sum(cnt) AS v
  FROM counts JOIN subset USING (doc_id) JOIN known USING (word), width GROUP BY doc_id, i),
cells AS (SELECT s.doc_id, s.label, i, coalesce(v, 0) AS v FROM subset s CROSS JOIN width LEFT JOIN means USING (doc_id, i)),
covs AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM cells a JOIN cells b USING (doc_id) GROUP BY a.i, b.i),
lines AS (SELECT i, list(c ORDER BY j) AS r FROM covs GROUP BY i),
matrix AS (SELECT list(r ORDER BY i) AS m FROM lines),
trace AS (SELECT sum(c) AS total FROM covs WHERE i = j),
{power('one', 'matrix')},
rest AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - variance * axis[i] * axis[j])) AS m FROM one),
{power('two', 'rest')},
centred AS (SELECT doc_id, label, list(v - mean ORDER BY i) AS v
  FROM cells JOIN (SELECT i, avg(v) AS mean FROM cells GROUP BY i) USING (i) GROUP BY doc_id, label)"""


def _scores(by: str = "") -> str:
    """CTEs ``cls`` (per class) and ``sc`` (summary) over ``pred``; ``by`` ends in a comma."""
    group = f"GROUP BY {by[:-2]}" if by else ""
    return f"""
seen AS (SELECT {by}label AS class FROM pred UNION SELECT {by}prediction FROM pred),
cls AS (SELECT {', '.join('s.' + c for c in by[:-2].split(', ')) + ', ' if by else ''}s.class,
    count(*) FILTER (p.label = s.class AND p.prediction = s.class) AS tp,
    count(*) FILTER (p.prediction = s.class) AS predicted,
    count(*) FILTER (p.label = s.class) AS support
  FROM seen s JOIN pred p ON {' AND '.join(f'p.{c} = s.{c}' for c in by[:-2].split(', ')) if by else 'TRUE'}
  GROUP BY ALL),
rates AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f FROM cls),
sc AS (SELECT {by}round(sum(tp) / sum(support), 4) AS accuracy, round(avg(p), 4) AS precision,
    round(avg(r), 4) AS recall, round(avg(f), 4) AS f1_macro,
    round(sum(f * support) / sum(support), 4) AS f1_weighted FROM rates {group})"""


def _rule_results() -> str:
    by = "dataset, vectorizer, "
    return f"""WITH {LABELLED},
methods(vectorizer, width, fits, transforms) AS (VALUES ('keyword', 3, 0, 1), ('length', 1, 1, 1), ('majority', 0, 0, 0)),
truth AS (SELECT 'toxic' AS dataset, label, text, n_chars FROM docs
  UNION ALL SELECT 'review', quality, text, n_chars FROM docs),
pred AS (SELECT dataset, vectorizer, label, n_chars, CASE vectorizer
    WHEN 'keyword' THEN CAST(coalesce(regexp_matches(lower(text), '{INSULT}'), FALSE) AS INTEGER)
    WHEN 'length' THEN CAST(coalesce(n_chars > (SELECT avg(n_chars) FROM docs), FALSE) AS INTEGER)
    ELSE 0 END AS prediction FROM truth CROSS JOIN methods),
{_scores(by)},
chars AS (SELECT dataset, vectorizer, round(sum(n_chars) / 1000000, 3) AS mc FROM pred GROUP BY ALL),
results AS (SELECT dataset, vectorizer, CAST(m.width AS BIGINT) AS embedding_dim,
  CAST(mc * fits AS DOUBLE) AS fit_time_s, CAST(mc * transforms AS DOUBLE) AS transform_time_s,
  CAST(0 AS DOUBLE) AS classifier_train_time_s,
  sc.accuracy, sc.precision, sc.recall, sc.f1_macro, sc.f1_weighted
  FROM methods m JOIN sc USING (vectorizer) JOIN chars USING (dataset, vectorizer))
"""


def _quota_split() -> str:
    return f"""WITH {LABELLED},
sizes AS (SELECT label, count(*) AS n, (SELECT count(*) FROM docs) AS total FROM docs GROUP BY label),
exact AS (SELECT *, ceil(round(0.2 * total, 9)) AS t, ceil(round(0.2 * total, 9)) * n / total AS share FROM sizes),
ranked AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, label) AS place,
  t - sum(floor(share)) OVER () AS rest FROM exact),
quota AS (SELECT label, floor(share) + CASE WHEN place <= rest THEN 1 ELSE 0 END AS q FROM ranked),
drawn AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rn FROM docs)
SELECT doc_id, label, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split FROM drawn JOIN quota USING (label)"""


def _balanced(n: str) -> str:
    return f"""WITH {LABELLED},
sizes AS (SELECT min(c) AS smallest FROM (SELECT count(*) AS c FROM docs GROUP BY label)),
drawn AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rn FROM docs)"""


BOOTSTRAP = f"""
minority AS (SELECT doc_id, row_number() OVER (ORDER BY {KEY}) AS rank FROM docs WHERE label = 1),
draws AS (SELECT i AS draw_no, {_int("i || ':42'")} % (SELECT count(*) FROM minority) + 1 AS rank
  FROM range(1, (SELECT count(*) FROM docs WHERE label = 0) + 1) r(i)),
picked AS (SELECT draw_no, doc_id FROM draws JOIN minority USING (rank))"""


def oracle_sql() -> dict[str, str]:
    toks, docs = _tokens(), f"WITH {LABELLED}"
    results = _rule_results()
    order = ", ".join(f"('{k}', '{n}', '{f}', {o})" for k, n, f, o in RULES)
    char_grams = ", ".join(
        f"list_transform(range(1, length(m) - {n} + 2), lambda i: substr(m, i, {n}))" for n in (3, 4, 5, 6)
    )
    twins = {
        "scan_labelled": f"{docs} SELECT doc_id, text, label FROM docs",
        "vector_table": """
SELECT 'v' || vec_id AS word, i - 1 AS dim, round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)""",
        "dedupe_last": """
SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
FROM conversations) WHERE rn = 1""",
        "reviews_flatten": rf"""{docs},
paged AS (SELECT source, doc_id // {PAGE_SPAN} AS page, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, label FROM docs)
SELECT source, page, text, label FROM paged
WHERE {_int("source || ':' || page", 1)} > 0 AND length(text) BETWEEN 20 AND 512""",
        "reviews_until": rf"""{docs},
paged AS (SELECT source, doc_id // {PAGE_SPAN} AS page, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, label FROM docs),
ends AS (SELECT source, min(page) AS stop FROM paged WHERE {_int("source || ':' || page", 1)} = 0 GROUP BY source)
SELECT source, text, label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, doc_id) AS rn
  FROM paged LEFT JOIN ends USING (source) WHERE (stop IS NULL OR page < stop) AND length(text) BETWEEN 20 AND 512)
WHERE rn <= {REVIEW_TARGET}""",
        "binarise": """
SELECT doc_id, text, CASE WHEN coalesce(toxic, 0) + coalesce(1 - quality, 0) > 0 THEN 1 ELSE 0 END AS label
FROM documents JOIN labels USING (doc_id)""",
        "length_filter": """
SELECT doc_id, length(text) AS n, text FROM documents WHERE text IS NOT NULL AND length(text) BETWEEN 20 AND 512""",
        "class_totals": f"{docs} SELECT label, count(*) AS n FROM docs GROUP BY label",
        "class_balance": f"""{docs}
SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 4) AS pos_rate FROM docs""",
        "group_breakdown": f"""{docs}
SELECT source, count(*) AS total, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
FROM docs GROUP BY source""",
        "class_weights": f"""{docs}
SELECT label, count(*) AS n,
  round((SELECT count(*) / count(DISTINCT label) FROM docs) / count(*), 6) AS weight FROM docs GROUP BY label""",
        "prepare_comments": f"""WITH rows AS (SELECT doc_id, text, CASE WHEN coalesce(toxic, 0) + coalesce(1 - quality, 0) > 0 THEN 1 ELSE 0 END AS label
  FROM documents JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 1) AS m FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rank FROM rows),
draws AS (SELECT i AS draw_no, {_int("i || ':42'")} % (SELECT m FROM n) + 1 AS rank FROM range(1, (SELECT n FROM n) + 1) r(i)),
drawn AS (SELECT doc_id, text, label, 0 AS draw_no FROM ranked, n WHERE rank <= n AND (label = 0 OR m >= n)
  UNION ALL SELECT doc_id, text, label, draw_no FROM ranked JOIN draws USING (rank), n WHERE label = 1 AND m < n)
SELECT row_number() OVER (ORDER BY md5(doc_id || ':' || draw_no || ':42')) AS place, text, label FROM drawn""",
        "prepare_reviews": f"""WITH kept AS (SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)
  WHERE text IS NOT NULL AND length(text) BETWEEN 20 AND 512),
n AS (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1), 20000) AS n FROM kept),
drawn AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY}) AS rn FROM kept)
SELECT row_number() OVER (ORDER BY {KEY}) AS place, text, label FROM drawn, n WHERE rn <= n""",
        "shuffled": f"SELECT doc_id, row_number() OVER (ORDER BY {KEY}) AS rank FROM documents",
        "balance_n": f"""{docs}, {BOOTSTRAP}
SELECT doc_id, label, CAST(0 AS BIGINT) AS draw_no FROM docs WHERE label = 0
UNION ALL SELECT doc_id, 1, draw_no FROM picked""",
        "balance_min": f"""{_balanced('smallest')}
SELECT doc_id, label FROM drawn WHERE rn <= (SELECT least(smallest, 20000) FROM sizes)""",
        "projection_subset": f"{_balanced('half')} SELECT doc_id, label FROM drawn WHERE rn <= (SELECT smallest FROM sizes)",
        "balance_and_split": f"""{_balanced('smallest')},
n AS (SELECT least(smallest, 20000) AS n FROM sizes),
test AS (SELECT n, ceil(round(0.2 * 2 * n, 9)) AS t FROM n)
SELECT doc_id, label, CASE WHEN rn <= floor(t / 2) + CASE WHEN label = 0 THEN t % 2 ELSE 0 END THEN 'test' ELSE 'train' END AS split
FROM drawn, test WHERE rn <= n""",
        "stratified_split": _quota_split(),
        "cap_per_group": f"""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
FROM documents WHERE length(text) BETWEEN 20 AND 512) WHERE rn <= {CAP_PER_SOURCE}""",
        "bootstrap_draw": f"{docs}, {BOOTSTRAP} SELECT draw_no, doc_id FROM picked",
        "strip_urls": f"""
SELECT page_id, regexp_replace(lower(url || ' ' || html), '{URL}', ' ', 'g') AS stripped FROM pages""",
        "strip_html": "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS stripped FROM pages",
        "strip_nonalnum": r"""
SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g') AS stripped FROM documents""",
        "normalise_space": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS normal FROM documents",
        "clean_text": f"WITH {toks} SELECT doc_id, array_to_string(tokens, ' ') AS clean FROM toks",
        "tokens": f"""WITH {toks}
SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, '|') AS tokens FROM toks""",
        "stopwords_removed": f"""WITH {toks}
SELECT doc_id, len(words) - len(tokens) AS n_removed, array_to_string(tokens, ' ') AS kept FROM toks""",
        "ngrams": f"""WITH {toks}, {GRAMS}
SELECT doc_id, len(g) AS n_grams, array_to_string(g, '|') AS grams FROM grams""",
        "char_ngrams": f"""WITH {toks}, {WORDS}, marked AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM words)
SELECT word, array_to_string(flatten([{char_grams}]), '|') AS grams FROM marked""",
        "term_stats": f"WITH {toks}, {GRAMS} SELECT term, tf, df FROM stats",
        "vocab_size": f"""WITH {toks}, {GRAMS}
SELECT count(*) AS n_terms, count(*) FILTER (df >= 2) AS n_min_df,
  count(*) FILTER (tf >= 2 AND NOT contains(term, ' ')) AS n_words FROM stats""",
        "bow_vocab": f"WITH {toks}, {GRAMS}, {_vocabulary(1)} SELECT term, tf, df, idx FROM vocab",
        "tfidf_vocab": f"WITH {toks}, {GRAMS}, {_vocabulary(2)} SELECT term, tf, df, idx FROM vocab",
        "idf": f"""WITH {toks}, {GRAMS}, {_vocabulary(2)}, n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS smooth, round(ln(n / df), 6) AS plain FROM vocab, n""",
        "bow_transform": f"""WITH {toks}, {GRAMS}, {_vocabulary(1)}
SELECT doc_id, idx, count(*) AS cnt FROM terms JOIN vocab USING (term) GROUP BY doc_id, idx""",
        "tfidf_transform": f"""WITH {toks}, {GRAMS}, {_vocabulary(2)}, n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT doc_id, idx, (1 + ln(count(*))) * (ln((1 + any_value(n)) / (1 + any_value(df))) + 1) AS w
  FROM terms JOIN vocab USING (term), n GROUP BY doc_id, idx)
SELECT doc_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
        "w2v_vocab": f"WITH {toks}, {WORDS} SELECT word, count(*) AS tf FROM words GROUP BY word HAVING count(*) >= 2",
        "oov_inner_join": f"""WITH {toks}, {WORDS}, {KNOWN}
SELECT word, doc_id, cnt, vec_id FROM counts JOIN known USING (word)""",
        "oov_tokens": f"""WITH {toks}, {WORDS}, {KNOWN}
SELECT word, doc_id, cnt FROM counts WHERE word NOT IN (SELECT word FROM known)""",
        "mean_pool": f"""WITH {toks}, {WORDS}, {KNOWN},
width AS (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i),
pooled AS (SELECT doc_id, i, sum(cnt * CAST(vector[i] AS DOUBLE)) / sum(cnt) AS v
  FROM counts JOIN known USING (word), width GROUP BY doc_id, i)
SELECT d.doc_id, i - 1 AS dim, {_rounded('coalesce(v, 0)')} AS value
FROM documents d CROSS JOIN width LEFT JOIN pooled USING (doc_id, i)""",
        "mean_pool_join": f"""WITH {toks}, {WORDS}, {KNOWN},
width AS (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i),
pooled AS (SELECT doc_id, i, sum(cnt * CAST(vector[i] AS DOUBLE)) / sum(cnt) AS v
  FROM counts JOIN known USING (word), width GROUP BY doc_id, i)
SELECT d.doc_id, i - 1 AS dim, {_rounded('coalesce(v, 0)')} AS value
FROM documents d CROSS JOIN width LEFT JOIN pooled USING (doc_id, i)""",
        "word_pairs": f"WITH {toks}, {WORDS}, {PAIRS} SELECT a, b, n FROM pairs",
        "word_pmi": f"WITH {toks}, {WORDS}, {PAIRS}, {PMI} SELECT a, b, round(pmi, 6) AS pmi FROM pmi WHERE pmi > 0",
        "word2vec_vectors": f"WITH {toks}, {WORDS}, {PAIRS}, {PMI}, {VECTORS} {_digest('word', 'vectors')}",
        "word2vec_docs": f"""WITH {toks}, {WORDS}, {PAIRS}, {PMI}, {VECTORS},
counts AS (SELECT doc_id, word, count(*) AS cnt FROM words GROUP BY doc_id, word),
pooled AS (SELECT doc_id, {_mean('cnt')} AS v FROM counts JOIN vectors USING (word) GROUP BY doc_id),
each AS (SELECT doc_id, coalesce(v, list_transform(range({DIMS}), lambda i: CAST(0 AS DOUBLE))) AS v FROM documents LEFT JOIN pooled USING (doc_id))
{_digest('doc_id', 'each')}""",
        "fasttext_vectors": f"""WITH {toks}, {WORDS}, {PAIRS}, {PMI}, {VECTORS}, {_subwords(char_grams)},
each AS (SELECT * FROM built WHERE word IN (SELECT word FROM vocab)) {_digest('word', 'each')}""",
        "fasttext_docs": f"""WITH {toks}, {WORDS}, {PAIRS}, {PMI}, {VECTORS}, {_subwords(char_grams)},
counts AS (SELECT doc_id, word, count(*) AS cnt FROM words GROUP BY doc_id, word),
pooled AS (SELECT doc_id, {_mean('cnt')} AS v FROM counts JOIN built USING (word) GROUP BY doc_id),
each AS (SELECT doc_id, coalesce(v, list_transform(range({DIMS}), lambda i: CAST(0 AS DOUBLE))) AS v FROM documents LEFT JOIN pooled USING (doc_id))
{_digest('doc_id', 'each')}""",
        "subword_vectors": f"""WITH {toks}, {WORDS}, {KNOWN},
marked AS (SELECT DISTINCT word, '<' || word || '>' AS m FROM words),
pieces AS (SELECT word, unnest(flatten([{char_grams}])) AS gram FROM marked),
sums AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[-1] AS DOUBLE) AS z,
  list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS t,
  list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) AS r FROM embeddings),
parts AS (SELECT word, {_int('gram')} % (SELECT count(*) FROM embeddings) AS vec_id FROM pieces
  UNION ALL SELECT word, vec_id FROM known)
SELECT word, {_rounded('avg(a)')} AS first, {_rounded('avg(z)')} AS last, {_rounded('avg(t)')} AS total,
  {_rounded('avg(r)')} AS ramp FROM parts JOIN sums USING (vec_id) GROUP BY word""",
        "lr_score": f"""WITH {LABELLED}, {_tokens('docs')}, {GRAMS}, {_vocabulary(2)},
counts AS (SELECT doc_id, idx, count(*) AS cnt FROM terms JOIN vocab USING (term) GROUP BY doc_id, idx),
sizes AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM docs),
coefs AS (SELECT idx, ln((count(*) FILTER (label = 1) + 1) / (any_value(n1) + 2))
    - ln((count(*) FILTER (label = 0) + 1) / (any_value(n0) + 2)) AS coef
  FROM counts JOIN docs USING (doc_id), sizes GROUP BY idx),
sums AS (SELECT doc_id, sum(cnt * coef) AS s FROM counts JOIN coefs USING (idx) GROUP BY doc_id),
scored AS (SELECT doc_id, label, coalesce(s, 0) + ln((n1 + 1) / (n0 + 1)) AS score
  FROM docs LEFT JOIN sums USING (doc_id), sizes)
SELECT doc_id, label, round(score, 4) AS score, CAST(round(score, 6) > 0 AS INTEGER) AS prediction FROM scored""",
        "lr_newton": f"""WITH RECURSIVE {LABELLED},
sizes AS (SELECT label, (SELECT count(*) FROM docs) / ((SELECT count(DISTINCT label) FROM docs) * count(*)) AS w FROM docs GROUP BY label),
x AS (SELECT label AS y, w, ln(n_chars + 1.0) / 10 AS f, CAST(CAST(regexp_matches(lower(text), '{INSULT}') AS INTEGER) AS DOUBLE) AS g FROM docs JOIN sizes USING (label)),
newton AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d
  UNION ALL
  SELECT k + 1, b - (gf * (gg * oo - go * go) - ug * (fg * oo - go * fo) + uo * (fg * go - gg * fo)) / det,
    c - (ff * (ug * oo - uo * go) - fg * (gf * oo - uo * fo) + fo * (gf * go - ug * fo)) / det,
    d - (ff * (gg * uo - go * ug) - fg * (fg * uo - go * gf) + fo * (fg * ug - gg * gf)) / det
  FROM (SELECT *, ff * (gg * oo - go * go) - fg * (fg * oo - go * fo) + fo * (fg * go - gg * fo) AS det FROM (
    SELECT k, b, c, d, sum(h * f * f) + 1 AS ff, sum(h * f * g) AS fg, sum(h * f) AS fo, sum(h * g * g) + 1 AS gg, sum(h * g) AS go, sum(h) AS oo,
      sum(e * f) + b AS gf, sum(e * g) + c AS ug, sum(e) AS uo
    FROM (SELECT k, b, c, d, f, g, w * p * (1 - p) AS h, w * (p - y) AS e FROM (
      SELECT *, 1 / (1 + exp(-(b * f + c * g + d))) AS p FROM newton, x WHERE k < 12)) GROUP BY k, b, c, d)))
SELECT CAST(0 AS BIGINT) AS idx, round(b, 6) AS coef FROM newton WHERE k = 12
UNION ALL SELECT 1, round(c, 6) FROM newton WHERE k = 12 UNION ALL SELECT 2, round(d, 6) FROM newton WHERE k = 12""",
        "confusion": f"""{docs}, {PREDICTED}
SELECT label, prediction, count(*) AS n FROM pred GROUP BY label, prediction""",
        "metrics": f"{docs}, {PREDICTED}, {_scores()} SELECT * FROM sc",
        "class_report": f"""{docs}, {PREDICTED}, {_scores()},
lines AS (
  SELECT CASE class WHEN 0 THEN 'non-toxic' ELSE 'toxic' END AS row, p, r, f, support FROM rates
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM rates
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM rates
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM rates)
SELECT row, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, CAST(support AS BIGINT) AS support
FROM lines""",
        "results_scan": f"{results} SELECT * FROM results",
        "results_union": f"""{results}
SELECT * REPLACE (CASE WHEN vectorizer = 'keyword' THEN classifier_train_time_s END AS classifier_train_time_s)
FROM results""",
        "leaderboard": f"""{results}, expected(vectorizer, display_name, family, display_order) AS (VALUES {order}),
datasets AS (SELECT DISTINCT dataset FROM results)
SELECT d.dataset, e.display_order, e.vectorizer, e.display_name, e.family, CAST(r.embedding_dim AS DOUBLE) AS embedding_dim, r.fit_time_s,
  r.transform_time_s, r.accuracy, r.f1_macro, r.f1_weighted, r.accuracy IS NOT NULL AS available
FROM datasets d CROSS JOIN expected e LEFT JOIN results r ON r.dataset = d.dataset AND r.vectorizer = e.vectorizer""",
        "tradeoff": f"""{results}
SELECT dataset, vectorizer, upper(vectorizer[1]) || lower(vectorizer[2:]) AS display,
  round(fit_time_s + transform_time_s, 3) AS total_time_s, f1_macro FROM results""",
        "metrics_long": f"""{results}
SELECT dataset, vectorizer, metric, value FROM (SELECT dataset, vectorizer, accuracy, precision, recall, f1_macro
FROM results) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_macro))""",
        "metrics_matrix": f"""{results}
SELECT dataset, upper(vectorizer[1]) || lower(vectorizer[2:]) AS display, round(accuracy, 3) AS accuracy,
  round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1_macro, 3) AS f1_macro,
  round(f1_weighted, 3) AS f1_weighted FROM results""",
        "f1_by_method": f"""{results}
SELECT dataset, vectorizer, f1_macro,
  round(least(1.0, max(f1_macro) OVER (PARTITION BY dataset) + 0.08), 4) AS axis_max FROM results""",
        "best_method": f"""{results}
SELECT dataset, vectorizer, f1_macro FROM (SELECT *, row_number() OVER (PARTITION BY dataset
  ORDER BY f1_macro DESC, vectorizer) AS rn FROM results) WHERE rn = 1""",
        "project_variance": f"""{_axes(toks)}
SELECT CAST(1 AS BIGINT) AS component, round(variance, 6) AS variance, round(variance / total, 6) AS share FROM one, trace
UNION ALL SELECT 2, round(variance, 6), round(variance / total, 6) FROM two, trace""",
        "project_documents": f"""{_axes(toks)}
SELECT doc_id, label, {_rounded('list_dot_product(v, one.axis)')} AS x, {_rounded('list_dot_product(v, two.axis)')} AS y FROM centred, one, two""",
        "class_centroids": """
SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) GROUP BY label, i""",
        "class_separation": """
WITH pairs AS (SELECT a.vec_id, a.label, b.label AS other,
    list_sum(list_transform(list_zip(a.embedding, b.embedding),
      lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS d
  FROM embeddings a CROSS JOIN embeddings b),
means AS (SELECT vec_id, label, other, sum(d) AS total, count(*) AS n FROM pairs GROUP BY vec_id, label, other),
own AS (SELECT vec_id, n, CASE WHEN n > 1 THEN total / (n - 1) END AS a FROM means WHERE label = other),
near AS (SELECT vec_id, min(total / n) AS b FROM means WHERE label <> other GROUP BY vec_id)
SELECT count(*) AS n_rows, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM own JOIN near USING (vec_id)""",
    }
    for name in ("clean_text", "tokens", "ngrams"):
        twins[f"sql_{name}"] = twins[name]
    return twins
