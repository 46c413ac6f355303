"""SQL for the queries of ``checks.queries``, over the same tables.

Written independently of the library where SQL allows it: n-grams are unnested
and counted, Kendall's pairs are compared one by one, p-values are summed as
series.
"""

from __future__ import annotations

# --- shared pieces ------------------------------------------------------------------------

SPACE = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

RATED = """r AS (
  SELECT d.doc_id AS row_id, d.source AS createdBy_id, l.quality::DOUBLE AS score,
         d.text AS sourceText, d.text AS targetText, b.text AS referenceText
  FROM documents d JOIN labels l USING (doc_id)
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

EVENTS = "e AS (SELECT event_id AS row_id, user_id AS createdBy_id, value AS score FROM events)"

EVENT_SCORES = """s AS (
  SELECT event_id AS id, 'hour' AS metric, hour(ts)::DOUBLE AS x, value AS y FROM events
  UNION ALL
  SELECT event_id, 'key', (props::JSON ->> '$.k')::DOUBLE, value FROM events)"""

LINE_SCORES = """s AS (
  SELECT 'l_quantity' AS metric, l_quantity AS x, l_extendedprice AS y FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem)"""


def zscored(source: str, at_least: int) -> str:
    """CTE ``z`` with ``standardized_score`` per rater."""
    return f"""stats AS (
  SELECT createdBy_id, count(*) AS n, count(score) AS ns, avg(score) AS mu, stddev_samp(score) AS sd, min(score) AS lo, max(score) AS hi
  FROM {source} WHERE createdBy_id IS NOT NULL GROUP BY 1),
z AS (
  SELECT t.*, CASE WHEN ns < 2 THEN NULL WHEN lo = hi THEN 0.0 ELSE (t.score - mu) / sd END AS standardized_score
  FROM {source} t JOIN stats USING (createdBy_id) WHERE n >= {at_least})"""


# Coefficients of the pairs in ``s(id, metric, x, y)``; ``c`` has one row per metric.
CORRELATED = """ranks AS (
  SELECT *, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0 AS ry
  FROM s),
base AS (
  SELECT metric, count(*) AS n, min(x) < max(x) AND min(y) < max(y) AS varies,
         CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson,
         CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM ranks GROUP BY metric),
compared AS (
  SELECT a.metric, sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s_,
         count(*) FILTER (WHERE sign(a.x - b.x) * sign(a.y - b.y) < 0) AS discordant,
         count(*) FILTER (WHERE a.x = b.x)::DOUBLE AS tx, count(*) FILTER (WHERE a.y = b.y)::DOUBLE AS ty
  FROM s a JOIN s b ON a.metric = b.metric AND a.id < b.id GROUP BY a.metric),
xs AS (SELECT metric, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS q
       FROM (SELECT metric, x, count(*)::DOUBLE AS t FROM s GROUP BY ALL) GROUP BY metric),
ys AS (SELECT metric, sum(t * (t - 1) * (2 * t + 5)) AS v, sum(t * (t - 1) * (t - 2)) AS q
       FROM (SELECT metric, y, count(*)::DOUBLE AS t FROM s GROUP BY ALL) GROUP BY metric),
c AS (
  SELECT metric, n, pearson, spearman, discordant,
         CASE WHEN varies THEN s_ / (sqrt(n * (n - 1) / 2.0 - tx) * sqrt(n * (n - 1) / 2.0 - ty)) END AS kendall,
         CASE WHEN varies THEN s_ / sqrt((n * (n - 1.0) * (2 * n + 5) - xs.v - ys.v) / 18 + 2 * tx * ty / (n * (n - 1.0))
                   + xs.q * ys.q / (9 * n * (n - 1.0) * (n - 2))) END AS kendall_z
  FROM base JOIN compared USING (metric) JOIN xs USING (metric) JOIN ys USING (metric))"""

# p-values by series of positive terms: the incomplete beta function for t tests, erf for Kendall.
P_VALUES = """k AS (SELECT unnest(range(0, 20000)) AS k),
coefficient AS (
  SELECT metric, 'pearson' AS kind, pearson AS r, (n - 2) / 2.0 AS a FROM c UNION ALL SELECT metric, 'spearman', spearman, (n - 2) / 2.0 FROM c),
beta AS (
  SELECT metric, kind, 0.5 * ln(r * r) + a * ln(1 - r * r) - ln(0.5) - (lgamma(0.5) + lgamma(a) - lgamma(a + 0.5))
         + coalesce(sum(ln((a + 0.5 + k) / (1.5 + k) * r * r)) OVER (PARTITION BY metric, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS log_term
  FROM coefficient, k),
tested AS (SELECT metric, kind, CASE WHEN sum(exp(log_term)) IS NOT NULL THEN greatest(0.0, 1 - sum(exp(log_term))) END AS p FROM beta GROUP BY ALL),
erf_terms AS (
  SELECT metric, ln(2 / sqrt(pi())) - u * u + ln(u)
         + coalesce(sum(ln(2 * u * u / (2 * k + 3))) OVER (PARTITION BY metric ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS log_term
  FROM (SELECT metric, abs(kendall_z) / sqrt(2) AS u FROM c), k),
ranked_test AS (SELECT metric, CASE WHEN sum(exp(log_term)) IS NOT NULL THEN greatest(0.0, 1 - sum(exp(log_term))) END AS p FROM erf_terms GROUP BY metric),
p AS (
  SELECT c.*, a.p AS p_value_pearson, b.p AS p_value_spearman, t.p AS p_value_kendall
  FROM c JOIN tested a ON a.metric = c.metric AND a.kind = 'pearson'
  JOIN tested b ON b.metric = c.metric AND b.kind = 'spearman' JOIN ranked_test t ON t.metric = c.metric)"""

SIGNIFICANCE = """CASE WHEN least(p_value_pearson, p_value_spearman, p_value_kendall) IS NULL THEN NULL
       WHEN least(p_value_pearson, p_value_spearman, p_value_kendall) < 0.001 THEN 'highly_significant'
       WHEN least(p_value_pearson, p_value_spearman, p_value_kendall) < 0.01 THEN 'significant'
       WHEN least(p_value_pearson, p_value_spearman, p_value_kendall) < 0.05 THEN 'marginally_significant'
       ELSE 'not_significant' END"""


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACE}+', ' ', 'g'))"


def tokens(text: str) -> str:
    """Blank-separated words of a squeezed text as a list."""
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def mteval(text: str) -> str:
    out = f"regexp_replace({text}, '{SPACE}+$', '')"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        out = f"replace({out}, {old}, {new})"
    out = f"(' ' || {out} || ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return squeezed(out)


def split_marks(text: str) -> str:
    """Words with one punctuation mark split off the end, else the start."""
    mark = "[!-/:-@\\[-`{-~]"
    return f"""flatten(list_transform({tokens(squeezed(text))}, lambda w:
      CASE WHEN length(w) = 1 THEN [w]
           WHEN regexp_matches(w, '{mark}$') THEN [w[:-2], w[-1:]]
           WHEN regexp_matches(w, '^{mark}') THEN [w[1:1], w[2:]]
           ELSE [w] END))"""


def gram_counts(source: str, orders: int, glue: str, tag: str) -> str:
    """``(tag, row_id, n, match)`` for two token lists ``h`` and ``f`` of ``source``."""
    following = ", ".join(f"lead(tok, {k}) OVER side AS t{k}" for k in range(1, orders))
    grams = " UNION ALL ".join(
        f"SELECT row_id, {n} AS n, side, {f" || '{glue}' || ".join(['tok', *[f't{k}' for k in range(1, n)]])} AS gram FROM placed"
        + (f" WHERE t{n - 1} IS NOT NULL" if n > 1 else "")
        for n in range(1, orders + 1)
    )
    return f"""(SELECT '{tag}' AS tag, row_id, n, sum(least(ch, cf))::BIGINT AS match FROM (
    WITH units AS (
      SELECT row_id, 'h' AS side, unnest(h) AS tok, generate_subscripts(h, 1) AS place FROM {source}
      UNION ALL SELECT row_id, 'f', unnest(f), generate_subscripts(f, 1) FROM {source}),
    placed AS (SELECT row_id, side, tok, {following} FROM units WINDOW side AS (PARTITION BY row_id, side ORDER BY place))
    SELECT row_id, n, gram, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'f') AS cf FROM ({grams}) GROUP BY ALL) GROUP BY ALL)"""


BLEU = f"""bt AS (SELECT row_id, {tokens(mteval('targetText'))} AS h, {tokens(mteval('referenceText'))} AS f FROM r),
bm AS (SELECT row_id, n, match FROM {gram_counts('bt', 4, ' ', 'w')}),
bo AS (
  SELECT bt.row_id, len(h) AS hl, len(f) AS fl, o.n, len(h) - o.n + 1 AS total, coalesce(match, 0) AS match
  FROM bt CROSS JOIN (SELECT unnest(range(1, 5)) AS n) o LEFT JOIN bm ON bm.row_id = bt.row_id AND bm.n = o.n),
bs AS (
  SELECT *, count(*) FILTER (WHERE match = 0 AND total > 0) OVER (PARTITION BY row_id ORDER BY n) AS unmatched FROM bo),
bleu AS (
  SELECT row_id, CASE WHEN sum(match) = 0 THEN 0.0 ELSE
      (CASE WHEN any_value(hl) < any_value(fl) THEN exp(1 - any_value(fl) / any_value(hl)) ELSE 1.0 END)
      * exp(avg(CASE WHEN match > 0 THEN ln(100.0 * match / total) ELSE ln(100.0 / (2 ** unmatched * total)) END) FILTER (WHERE total > 0)) END AS bleu_score
  FROM bs GROUP BY row_id)"""

CHRF = f"""ct AS (
  SELECT row_id, list_filter(string_split(regexp_replace(targetText, '{SPACE}+', '', 'g'), ''), lambda c: c <> '') AS h,
         list_filter(string_split(regexp_replace(referenceText, '{SPACE}+', '', 'g'), ''), lambda c: c <> '') AS f FROM r),
wt AS (SELECT row_id, {split_marks('targetText')} AS h, {split_marks('referenceText')} AS f FROM r),
cm AS ({gram_counts('ct', 6, '', 'c')} UNION ALL {gram_counts('wt', 2, ' ', 'w')}),
co AS (
  SELECT sizes.tag, sizes.row_id, o.n, hl - o.n + 1 AS ht, fl - o.n + 1 AS ft, coalesce(match, 0) AS match
  FROM (SELECT 'c' AS tag, row_id, len(h) AS hl, len(f) AS fl FROM ct UNION ALL SELECT 'w', row_id, len(h), len(f) FROM wt) sizes
  JOIN (SELECT 'c' AS tag, unnest(range(1, 7)) AS n UNION ALL SELECT 'w', unnest(range(1, 3))) o ON o.tag = sizes.tag
  LEFT JOIN cm ON cm.tag = sizes.tag AND cm.row_id = sizes.row_id AND cm.n = o.n),
ca AS (
  SELECT row_id, coalesce(avg(match / ht) FILTER (WHERE ht > 0 AND ft > 0), 0) AS p,
         coalesce(avg(match / ft) FILTER (WHERE ht > 0 AND ft > 0), 0) AS q FROM co GROUP BY row_id),
chrf AS (SELECT row_id, CASE WHEN p + q > 0 THEN 100 * 5 * p * q / (4 * p + q) ELSE 0.0 END AS chrfplusplus_score FROM ca)"""

# The references have fewer than 90 distinct words, so each word fits one ASCII character.
EDITS = f"""et AS (SELECT row_id, {tokens(squeezed('lower(targetText)'))} AS h, {tokens(squeezed('lower(referenceText)'))} AS f FROM r),
ev AS (SELECT *, list_distinct(f) AS v FROM et),
ee AS (
  SELECT row_id, len(h) AS hl, len(f) AS fl,
    levenshtein(array_to_string(list_transform(h, lambda w: chr(33 + coalesce(list_position(v, w), 0)::INT)), ''),
                array_to_string(list_transform(f, lambda w: chr(33 + list_position(v, w)::INT)), '')) AS edits FROM ev),
wer AS (
  SELECT row_id, CASE WHEN fl = 0 THEN (CASE WHEN hl > 0 THEN 100.0 ELSE 0.0 END) ELSE 100.0 * edits / fl END AS word_edit_rate FROM ee)"""


def longest_common(words: str) -> str:
    """CTEs giving ``rouge``; the references have fewer than 120 tokens, so one integer holds a row of the table."""
    return f"""rt AS (SELECT row_id, {words.format('targetText')} AS h, {words.format('referenceText')} AS f FROM r),
rm AS (
  SELECT row_id, len(h) AS hl, len(f) AS fl, (1::HUGEINT << len(f)::HUGEINT) - 1 AS ones,
    list_transform(list_filter(h, lambda w: list_contains(f, w)), lambda w:
      list_sum(list_transform(range(0, len(f)), lambda j: CASE WHEN f[j + 1] = w THEN 1::HUGEINT << j::HUGEINT ELSE 0::HUGEINT END))::HUGEINT) AS masks
  FROM rt),
rl AS (
  SELECT row_id, hl, fl, fl - bit_count(list_reduce(list_prepend(ones, masks), lambda v, m: ((v + (v & m)) | (v & ~m)) & ones)) AS lcs FROM rm),
rouge AS (SELECT row_id, CASE WHEN hl = 0 OR fl = 0 THEN 0.0 ELSE 2.0 * lcs / (hl + fl) END AS rouge_score FROM rl)"""


ASCII_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def stemmed(words: str) -> str:
    """Porter stems of a list of words, step by step."""
    v, c = "[aeiouy]", "[^aeiouy]"
    above_0, above_1, is_1 = f"{c}*{v}+{c}.*", f"{c}*{v}+{c}+{v}+{c}.*", f"^{c}*{v}+{c}+{v}*$"
    short = f"({c}{v}[^aeiouywxY]|^{v}{c})$"
    double = "|".join(x + x for x in "bcdfghjklmnpqrstvwxYz0123456789") + "|yY"

    def cases(rules, otherwise="w"):
        return "CASE " + " ".join(f"WHEN w LIKE '%{suffix}' THEN {result}" for suffix, result in rules) + f" ELSE {otherwise} END"

    def cut(stem, suffix, new=""):
        return f"regexp_replace(w, '^({stem}){suffix}$', '\\1{new}')"

    def repaired(suffix):
        rest = f"list_transform([regexp_replace(w, '{suffix}$', '')], lambda s: CASE WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e' " \
               f"WHEN regexp_matches(s, '({double})$') THEN regexp_replace(s, '[^lsz]$', '') " \
               f"WHEN regexp_matches(s, '{is_1}') AND regexp_matches(s, '{short}') THEN s || 'e' ELSE s END)[1]"
        return f"CASE WHEN regexp_matches(w, '{v}.*{suffix}$') THEN {rest} ELSE w END"

    step_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize")
    step_2 |= dict(ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", fulli="ful")
    step_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
    step_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
    ion = f"CASE WHEN regexp_matches(w, '[st]ion$') THEN {cut(above_1, 'ion')} ELSE w END"
    final_e = f"list_transform([w[:-2]], lambda s: CASE WHEN regexp_matches(s, '^{above_1}') OR (regexp_matches(s, '{is_1}') AND NOT regexp_matches(s, '{short}')) THEN s ELSE w END)[1]"
    steps = [
        "replace(regexp_replace(w, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY')",
        cases([("sses", "w[:-3]"), ("ies", "CASE WHEN length(w) = 4 THEN w[:-2] ELSE w[:-3] END"), ("ss", "w"), ("s", "w[:-2]")]),
        cases([("ied", "CASE WHEN length(w) = 4 THEN w[:-2] ELSE w[:-3] END"), ("eed", cut(above_0, "eed", "ee")), ("ed", repaired("ed")), ("ing", repaired("ing"))]),
        f"regexp_replace(w, '^(.+{c})y$', '\\1i')",
        cut(above_0, "alli", "al"),
        cases([(s, cut(above_0, s, new)) for s, new in step_2.items()] + [("logi", cut(above_0, "ogi", "og"))]),
        cases([(s, cut(above_0, s, new)) for s, new in step_3.items()]),
        cases([(s, ion if s == "ion" else cut(above_1, s)) for s in step_4]),
        cases([("e", final_e)]),
        cases([("ll", cut(above_1, "l"))]),
    ]
    irregular = "{'sky': 'sky', 'skies': 'sky', 'dying': 'die', 'lying': 'lie', 'tying': 'tie', 'innings': 'inning', 'outings': 'outing', 'cannings': 'canning'}"
    fixed = "('sky', 'skies', 'dying', 'lying', 'tying', 'news', 'innings', 'inning', 'outings', 'outing', 'cannings', 'canning', 'howe', 'proceed', 'exceed', 'succeed')"
    out = words
    for step in steps:
        out = f"list_transform({out}, lambda w: {step})"
    replaced = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{x}'" for k, x in (p.split(": ") for p in irregular.replace("'", "")[1:-1].split(", "))) + " ELSE t END"
    pairs = f"list_zip({words}, list_transform({out}, lambda w: lower(w)))"
    picked = f"CASE WHEN length(t) <= 3 THEN t WHEN t IN {fixed} THEN {replaced} ELSE u END"
    return f"list_transform({pairs}, lambda p: list_transform([p[1]], lambda t: list_transform([p[2]], lambda u: {picked})[1])[1])"


UNICODE_WORDS = r"list_filter(string_split(regexp_replace(lower({0}), '[^\pL\pM\pN]+', ' ', 'g'), ' '), lambda w: w <> '')"

SUMMARY = "avg({0}) AS mean, {1}({0}) AS {2}, min({0}) AS min, max({0}) AS max, count({0}) AS count"


def extracted(text: str) -> str:
    """Score parsing; the neighbours of a number are matched, since ``\\b`` only knows ASCII letters here."""
    number = r"([0-9]{1,3}(?:\.[0-9]+)?)"
    edge = r"[^\pL\pM\pN_\p{Pc}]"
    found = ", ".join(
        f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in (f"(?:^|{edge}){number}(?:$|{edge})", rf"Score:\s*{number}", number)
    )
    return f"least(coalesce(coalesce({found})::DOUBLE, 0.0), 100.0)"


EVENT_RESULTS = """res AS (
  SELECT event_id AS row_id, CASE event_type WHEN 'error' THEN 'errored' WHEN 'click' THEN 'expired' ELSE 'succeeded' END AS status,
         CASE WHEN event_type IN ('error', 'click') THEN 0.0 ELSE least(value, 100.0) END AS score FROM events)"""

DESCRIBED = """SELECT count({0}) AS count, round(avg({0}), {2}) + 0.0 AS mean, round(stddev_samp({0}), {2}) AS std_samp, round(min({0}), {2}) AS min,
  round(quantile_cont({0}, 0.25), {2}) AS p25, round(quantile_cont({0}, 0.5), {2}) AS p50, round(quantile_cont({0}, 0.75), {2}) AS p75,
  round(max({0}), {2}) AS max FROM {1}"""

AVERAGED = "(pearson + spearman + kendall) / 3"

STEMMED_WORDS = stemmed(ASCII_WORDS).replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}")

# Lexical scores and standardised labels of all rated documents: ``w`` has one row each.
EVALUATED = f"""{RATED}, {zscored('r', 5)}, {BLEU}, {CHRF}, {EDITS}, {longest_common(STEMMED_WORDS)},
w AS (SELECT row_id, round(standardized_score, 12) AS human_score, bleu_score, chrfplusplus_score, greatest(0.0, 1 - word_edit_rate / 100) AS wer_score, rouge_score
      FROM z JOIN bleu USING (row_id) JOIN chrf USING (row_id) JOIN wer USING (row_id) JOIN rouge USING (row_id))"""

LEXICAL_SCORES = """s AS (
  SELECT row_id AS id, 'BLEU' AS metric, bleu_score AS x, human_score AS y FROM w
  UNION ALL SELECT row_id, 'CHRF++', chrfplusplus_score, human_score FROM w
  UNION ALL SELECT row_id, 'WER', wer_score, human_score FROM w
  UNION ALL SELECT row_id, 'ROUGE', rouge_score, human_score FROM w)"""

# As ``w``, for the edit metric alone.
WER_ALONE = f"""{RATED}, {zscored('r', 5)}, {EDITS},
w AS (SELECT row_id, round(standardized_score, 12) AS human_score, greatest(0.0, 1 - word_edit_rate / 100) AS wer_score FROM z JOIN wer USING (row_id))"""

# Rankings of five metrics: ``copy`` ties with ``key``, ``minus`` turns ``hour`` around, ``absent`` has no value.
FIVE = """f AS (
  SELECT 'absent' AS metric, 0 AS ordinal, NULL::DOUBLE AS pearson, NULL::DOUBLE AS spearman, NULL::DOUBLE AS kendall
  UNION ALL SELECT 'key', 1, pearson, spearman, kendall FROM c WHERE metric = 'key'
  UNION ALL SELECT 'copy', 2, pearson, spearman, kendall FROM c WHERE metric = 'key'
  UNION ALL SELECT 'minus', 3, -pearson, -spearman, -kendall FROM c WHERE metric = 'hour'
  UNION ALL SELECT 'hour', 4, pearson, spearman, kendall FROM c WHERE metric = 'hour')"""



def corpus_scored(by: str) -> str:
    """Corpus scores of the rated documents, over the columns ``by``."""
    return f"""WITH {RATED}, {BLEU}, {CHRF},
bsum AS (
  SELECT {by}, n, sum(match)::DOUBLE AS match, sum(greatest(total, 0))::DOUBLE AS total, sum(hl)::DOUBLE AS hl, sum(fl)::DOUBLE AS fl
  FROM bo JOIN r USING (row_id) GROUP BY {by}, n),
bnum AS (SELECT *, count(*) FILTER (WHERE match = 0) OVER (PARTITION BY {by} ORDER BY n) AS unmatched FROM bsum),
bcorpus AS (
  SELECT {by}, CASE WHEN sum(match) = 0 OR min(total) = 0 THEN 0.0
      ELSE (CASE WHEN any_value(hl) < any_value(fl) THEN exp(1 - any_value(fl) / any_value(hl)) ELSE 1.0 END)
        * exp(avg(CASE WHEN total = 0 THEN 0 WHEN match > 0 THEN ln(100.0 * match / total) ELSE ln(100.0 / (2 ** unmatched * total)) END)) END AS corpus_bleu
  FROM bnum GROUP BY {by}),
csum AS (
  SELECT {by}, tag, n, sum(match)::DOUBLE AS match, sum(CASE WHEN ft > 0 THEN greatest(ht, 0) ELSE 0 END)::DOUBLE AS ht, sum(greatest(ft, 0))::DOUBLE AS ft
  FROM co JOIN r USING (row_id) GROUP BY {by}, tag, n),
cavg AS (
  SELECT {by}, coalesce(avg(match / ht) FILTER (WHERE ht > 0 AND ft > 0), 0) AS p,
         coalesce(avg(match / ft) FILTER (WHERE ht > 0 AND ft > 0), 0) AS q FROM csum GROUP BY {by}),
counted AS (SELECT {by}, count(*) AS n_rows FROM r WHERE targetText IS NOT NULL AND referenceText IS NOT NULL GROUP BY {by})
SELECT {by}, n_rows, round(corpus_bleu, 6) AS corpus_bleu, round(CASE WHEN p + q > 0 THEN 500 * p * q / (4 * p + q) ELSE 0.0 END, 6) AS corpus_chrfplusplus
FROM counted JOIN bcorpus USING ({by}) JOIN cavg USING ({by})"""


# --- one statement per query ----------------------------------------------------------------

ORACLES: dict[str, str] = {
    "rating_join": """SELECT o_totalprice AS score, o_custkey AS item_id, o_orderkey AS createdBy_id, c_name AS sourceText,
  c_mktsegment AS targetText, c_nationkey::VARCHAR AS targetID FROM orders JOIN customer ON o_custkey = c_custkey""",
    "reference_lookup_last_wins": """SELECT doc_id AS row_id, text AS sourceText, referenceText FROM documents JOIN (
  SELECT text, arg_max(concat_ws('/', source, doc_id::VARCHAR), doc_id) AS referenceText FROM documents GROUP BY text) USING (text)""",
    "reference_lookup_lenient": """SELECT doc_id AS row_id, text AS sourceText, referenceText FROM documents LEFT JOIN (
  SELECT text, arg_max(concat_ws('/', source, doc_id::VARCHAR), doc_id) AS referenceText
  FROM documents JOIN labels USING (doc_id) GROUP BY text) USING (text)""",
    "reference_missing": """SELECT text AS sourceText, count(*) AS n_rows FROM documents
  WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id)) GROUP BY text""",
    "drop_null_texts": """SELECT doc_id AS row_id, lang AS sourceText, text AS targetText, source AS referenceText
  FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""",
    "csv_round_trip": """SELECT doc_id AS row_id, lang AS sourceText, text AS targetText, source AS referenceText
  FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""",
    "active_raters": f"""WITH {EVENTS} SELECT * FROM e
  WHERE createdBy_id IN (SELECT createdBy_id FROM e GROUP BY 1 HAVING count(*) >= 60)""",
    "rater_filter_audit": f"""WITH {EVENTS}, n AS (SELECT createdBy_id, count(*) AS n FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS rows_before, count(*) AS raters_before, (sum(n) FILTER (WHERE n >= 60))::BIGINT AS rows_after,
  count(*) FILTER (WHERE n >= 60) AS raters_after, count(*) FILTER (WHERE n < 60) AS removed_raters,
  (sum(n) FILTER (WHERE n < 60))::BIGINT AS removed_rows,
  round(100.0 * (sum(n) FILTER (WHERE n < 60))::BIGINT / sum(n)::BIGINT, 6) AS removed_percent FROM n""",
    "rater_statistics": f"""WITH {EVENTS} SELECT createdBy_id, count(*) AS n_rows, count(score) AS n_scores, round(avg(score), 9) AS mean_score,
  round(stddev_samp(score), 9) AS std_score, min(score) AS min_score, max(score) AS max_score FROM e GROUP BY 1""",
    "rater_zscore": f"""WITH {EVENTS}, {zscored('e', 60)} SELECT row_id, createdBy_id, score, round(standardized_score, 9) + 0.0 AS standardized_score FROM z""",
    "rater_zscore_binary": f"""WITH {RATED}, {zscored('r', 5)} SELECT row_id, createdBy_id, score, round(standardized_score, 9) AS standardized_score FROM z""",
    "metric_summary_pop": f"WITH {LINE_SCORES}, t AS (SELECT metric, {SUMMARY.format('x', 'stddev_pop', 'std_pop')} FROM s GROUP BY 1) "
    "SELECT metric, round(mean, 9) AS mean, round(std_pop, 9) AS std_pop, min, max, count FROM t",
    "column_summary_samp": f"WITH {LINE_SCORES}, t AS (SELECT metric AS column_name, {SUMMARY.format('x', 'stddev_samp', 'std_samp')} FROM s GROUP BY 1) "
    "SELECT column_name, round(mean, 9) AS mean, round(std_samp, 9) AS std_samp, min, max, count FROM t",
    "describe_scores": f"WITH {EVENTS} {DESCRIBED.format('score', 'e', 9)}",
    "describe_standardized": f"WITH {EVENTS}, {zscored('e', 60)} {DESCRIBED.format('standardized_score', 'z', 6)}",
    "score_histogram20": f"""WITH {EVENTS}, m AS (SELECT min(score) AS lo, max(score) - min(score) AS w FROM e),
b AS (SELECT least(floor((score - lo) / w * 20), 19)::INT AS bin, count(*) AS n FROM e, m GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * w / 20, 9) AS bin_start, round(lo + (i + 1) * w / 20, 9) AS bin_end, coalesce(n, 0) AS n
FROM m, (SELECT unnest(range(0, 20)) AS i) LEFT JOIN b ON b.bin = i""",
    "preview": """SELECT o_totalprice AS score, o_custkey AS item_id, o_orderkey AS createdBy_id, c_name AS sourceText,
  c_mktsegment AS targetText, c_nationkey::VARCHAR AS targetID FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 5""",
    "pearson_lines": f"WITH {LINE_SCORES} SELECT metric, count(*) AS n, round(corr(x, y), 9) AS pearson FROM s GROUP BY 1",
    "pearson_events": f"WITH {EVENT_SCORES} SELECT metric, count(*) AS n, round(corr(x, y), 9) AS pearson FROM s GROUP BY 1",
    "spearman_avg_rank": f"""WITH {LINE_SCORES}, ranks AS (
  SELECT metric, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0 AS ry FROM s)
SELECT metric, count(*) AS n, round(corr(rx, ry), 9) AS spearman FROM ranks GROUP BY 1""",
    "kendall_tau_b": f"""WITH {EVENT_SCORES}, {CORRELATED}
SELECT metric, n, discordant, round(kendall, 9) AS kendall, round(kendall_z, 9) AS kendall_z FROM c""",
    "corr_pvalues": f"""WITH {EVENT_SCORES}, {CORRELATED}, {P_VALUES}
SELECT metric, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall,
  round(p_value_pearson, 6) AS p_value_pearson, round(p_value_spearman, 6) AS p_value_spearman, round(p_value_kendall, 6) AS p_value_kendall FROM p""",
    "corr_guards": """WITH n AS (SELECT count(*) AS n FROM events)
SELECT metric, CASE metric WHEN 'absent' THEN NULL WHEN 'infinite' THEN NULL WHEN 'single' THEN 1 ELSE n END AS n, r AS pearson, r AS spearman, r AS kendall,
  p AS p_value_pearson, p AS p_value_spearman, p AS p_value_kendall
FROM n, (VALUES ('constant', NULL, NULL), ('absent', NULL, NULL), ('infinite', NULL, NULL), ('single', NULL, NULL),
  ('itself', 1.0::DOUBLE, 0.0::DOUBLE), ('reversed', -1.0::DOUBLE, 0.0::DOUBLE)) v(metric, r, p)""",
    "best_metric": f"""WITH {EVENT_SCORES}, {CORRELATED}
SELECT arg_max(metric, pearson) AS best_pearson, arg_max(metric, spearman) AS best_spearman, arg_max(metric, kendall) AS best_kendall,
  arg_max(metric, {AVERAGED}) AS best_overall FROM c""",
    "top3_metrics": f"""WITH {EVENT_SCORES}, {CORRELATED}
SELECT metric, CASE metric WHEN 'key' THEN 0 ELSE 1 END AS ordinal, round({AVERAGED}, 9) AS avg_correlation FROM c ORDER BY {AVERAGED} DESC LIMIT 3""",
    "significance_class": f"""WITH {EVENT_SCORES}, {CORRELATED}, {P_VALUES}
SELECT metric, round(least(p_value_pearson, p_value_spearman, p_value_kendall), 6) AS min_p_value, {SIGNIFICANCE} AS significance FROM p""",
    "bleu_sentence": f"WITH {RATED}, {BLEU} SELECT row_id, round(bleu_score, 6) AS bleu_score FROM bleu",
    "chrf_pp": f"WITH {RATED}, {CHRF} SELECT row_id, round(chrfplusplus_score, 6) AS chrfplusplus_score FROM chrf",
    "word_edit_rate": f"WITH {RATED}, {EDITS} SELECT row_id, round(word_edit_rate, 6) AS word_edit_rate FROM wer",
    "word_edit_score": f"WITH {RATED}, {EDITS} SELECT row_id, round(greatest(0.0, 1 - word_edit_rate / 100), 6) AS wer_score FROM wer",
    "rouge_l": f"WITH {RATED}, {longest_common(ASCII_WORDS)} SELECT row_id, round(rouge_score, 6) AS rouge_score FROM rouge",
    "rouge_l_unicode": f"WITH {RATED}, {longest_common(UNICODE_WORDS)} SELECT row_id, round(rouge_score, 6) AS rouge_score FROM rouge",
    "rouge_l_stemmed": f"WITH {RATED}, {longest_common(STEMMED_WORDS)} SELECT row_id, round(rouge_score, 6) AS rouge_score FROM rouge",
    "registered_metric": f"""WITH {RATED} SELECT row_id, round(coalesce(least(length(targetText), length(referenceText))
  / nullif(greatest(length(targetText), length(referenceText)), 0), 1.0), 6) AS length_ratio_score FROM r""",
    "model_scoring": f"""WITH {RATED} SELECT row_id, round(least(1.0, length(targetText) / greatest(1, length(referenceText))), 6) AS comet_score FROM r""",
    "sampled_mean_fill": f"""WITH {RATED}, n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS place,
  least(1.0, length(targetText) / greatest(1, length(referenceText))) AS v FROM r)
SELECT row_id, round(CASE WHEN place <= 100 THEN v ELSE (SELECT avg(v) FROM n WHERE place <= 100) END, 9) AS comet_score, place > 100 AS is_imputed FROM n""",
    "first_rated_rows": f"WITH {EVENTS} SELECT * FROM e ORDER BY row_id LIMIT 1000",
    "attach_scores_wide": """SELECT o_orderkey AS row_id, o_orderstatus, aplus_score, b_c_score FROM orders LEFT JOIN (
  SELECT l_orderkey AS o_orderkey, max(l_quantity) AS aplus_score, min(l_discount) AS b_c_score FROM lineitem GROUP BY 1) USING (o_orderkey)""",
    "score_columns": """SELECT DISTINCT o_orderpriority AS metric, replace(replace(lower(o_orderpriority), '+', 'plus'), '-', '_') || '_score' AS column_name FROM orders""",
    "score_files": f"WITH {EVENT_SCORES} SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY id) - 1 AS row_id, x AS score FROM s",
    "run_summary": f"""WITH {EVENT_SCORES}, {CORRELATED}, m AS (SELECT metric, stddev_pop(x) AS std, count(*) AS count FROM s GROUP BY 1)
SELECT metric, round(pearson, 9) AS pearson, round(kendall, 9) AS kendall, round(std, 9) AS std, count FROM c JOIN m USING (metric)""",
    "judge_requests": """WITH t AS (
  SELECT a.conv_id * 1000 + a.turn AS row_id, CASE WHEN o.conv_id IS NULL THEN q.text END AS src, a.text AS hyp
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant'
  LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') o ON o.conv_id = q.conv_id)
SELECT 'eval_reference_free_' || row_id AS custom_id, json_object('custom_id', 'eval_reference_free_' || row_id, 'params',
  CASE WHEN src IS NULL THEN json_object('model', 'judge-1', 'max_tokens', 10, 'temperature', 0, 'system', 'Return 0', 'messages',
    json_array(json_object('role', 'user', 'content', '0')))
  ELSE json_object('model', 'judge-1', 'max_tokens', 100, 'temperature', 0, 'system', 'Rate the translation.', 'messages',
    json_array(json_object('role', 'user', 'content', json_array(json_object('type', 'text', 'text', 'No examples.'),
      json_object('type', 'text', 'text', concat('Source: ', src, chr(10), 'Translation: ', hyp, chr(10), 'Score:')))))) END)::VARCHAR AS request FROM t""",
    "judge_extract": f"SELECT doc_id, {extracted('text')} AS score FROM documents",
    "judge_results": f"WITH {EVENT_RESULTS} SELECT 'eval_reference_free_' || row_id AS custom_id, status, score FROM res",
    "judge_join": f"""WITH {EVENT_RESULTS} SELECT o_orderkey AS row_id, o_orderstatus, coalesce(score, 0.0) AS score, coalesce(status, 'missing') AS status
FROM orders LEFT JOIN res ON res.row_id = o_orderkey""",
    "judge_progress": f"""WITH {EVENT_RESULTS} SELECT count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status = 'errored') AS errored,
  0::BIGINT AS processing, 0::BIGINT AS canceled, count(*) FILTER (WHERE status = 'expired') AS expired, count(*) AS total,
  round(100.0 * count(*) FILTER (WHERE status = 'succeeded') / count(*), 6) AS percent FROM res""",
    "train_set": f"""WITH {RATED} SELECT row_id, sourceText AS src, targetText AS mt, referenceText AS ref, score AS raw, 'en-ka' AS lp,
  round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 9) AS score, 0 AS annotators, 'corp_dict' AS domain FROM r""",
    "valid_set": f"""WITH {RATED}, kept AS (SELECT * FROM r WHERE createdBy_id IN (SELECT createdBy_id FROM r GROUP BY 1 HAVING count(*) > 18))
SELECT row_id, createdBy_id, score AS raw, sourceText AS src, targetText AS mt, referenceText AS ref, 'en-ka' AS lp,
  round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 9) AS score FROM kept""",
    "evaluation_scores": f"""WITH {EVALUATED} SELECT row_id, round(human_score, 6) AS human_score, round(bleu_score, 6) AS bleu_score,
  round(chrfplusplus_score, 6) AS chrfplusplus_score, round(wer_score, 6) AS wer_score, round(rouge_score, 6) AS rouge_score FROM w""",
    "evaluation_report": f"""WITH {EVALUATED}, {LEXICAL_SCORES}, {CORRELATED}, {P_VALUES}
SELECT metric, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall,
  round(p_value_pearson, 6) AS p_value_pearson, round(p_value_spearman, 6) AS p_value_spearman, round(p_value_kendall, 6) AS p_value_kendall,
  CASE metric WHEN 'BLEU' THEN 0 WHEN 'CHRF++' THEN 1 WHEN 'WER' THEN 2 ELSE 3 END AS ordinal, round({AVERAGED}, 6) AS avg_correlation,
  round(least(p_value_pearson, p_value_spearman, p_value_kendall), 6) AS min_p_value, {SIGNIFICANCE} AS significance FROM p""",
    "metric_selection": f"""WITH {RATED}, {BLEU}, {CHRF} SELECT row_id, round(chrfplusplus_score, 6) AS chrfplusplus_score, round(bleu_score, 6) AS bleu_score
FROM chrf JOIN bleu USING (row_id)""",
    "model_output_shapes": f"""WITH {RATED} SELECT row_id, length(targetText)::DOUBLE AS object_score, length(referenceText)::DOUBLE AS list_score,
  length(sourceText)::DOUBLE AS column_score, 0.5::DOUBLE AS scalar_score FROM r""",
    "evaluation_with_failing_metric": f"WITH {WER_ALONE} SELECT row_id, round(human_score, 6) AS human_score, round(wer_score, 6) AS wer_score FROM w",
    "evaluation_extra_scores": f"""WITH {WER_ALONE} SELECT row_id, round(human_score, 6) AS human_score, round(wer_score, 6) AS wer_score,
  length(targetText)::DOUBLE AS length_score FROM w JOIN r USING (row_id)""",
    "evaluation_saved": f"""WITH {WER_ALONE}, {CHRF} SELECT round(human_score, 6) AS human_score, round(wer_score, 6) AS wer_score,
  round(chrfplusplus_score, 6) AS chrfplusplus_score FROM w JOIN chrf USING (row_id)""",
    "csv_annotation": f"""WITH {EVALUATED}, t AS (
  SELECT 'wer_score' AS column_name, {SUMMARY.format('wer_score', 'stddev_samp', 'std_samp')} FROM w
  UNION ALL SELECT 'rouge_score', {SUMMARY.format('rouge_score', 'stddev_samp', 'std_samp')} FROM w)
SELECT column_name, round(mean, 9) AS mean, round(std_samp, 9) AS std_samp, round(min, 9) AS min, round(max, 9) AS max, count FROM t""",
    "best_of_five": f"""WITH {EVENT_SCORES}, {CORRELATED}, {FIVE}
SELECT (SELECT metric FROM f ORDER BY pearson DESC NULLS LAST, ordinal LIMIT 1) AS best_pearson,
  (SELECT metric FROM f ORDER BY spearman DESC NULLS LAST, ordinal LIMIT 1) AS best_spearman,
  (SELECT metric FROM f ORDER BY kendall DESC NULLS LAST, ordinal LIMIT 1) AS best_kendall,
  (SELECT metric FROM f ORDER BY {AVERAGED} DESC NULLS LAST, ordinal LIMIT 1) AS best_overall""",
    "top3_of_five": f"""WITH {EVENT_SCORES}, {CORRELATED}, {FIVE}
SELECT metric, ordinal, round({AVERAGED}, 9) AS avg_correlation FROM f WHERE pearson IS NOT NULL ORDER BY {AVERAGED} DESC, ordinal LIMIT 3""",
    "judge_requests_with_references": """WITH t AS (
  SELECT a.conv_id * 1000 + a.turn AS row_id, q.text AS src, a.text AS hyp, b.text AS ref
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant'
  JOIN benchmark b ON b.item_id = q.conv_id % (SELECT count(*) FROM benchmark))
SELECT 'eval_reference_based_' || row_id AS custom_id, json_object('custom_id', 'eval_reference_based_' || row_id, 'params',
  json_object('model', 'judge-2', 'max_tokens', 1000, 'temperature', 0, 'system', 'Compare.', 'messages',
    json_array(json_object('role', 'user', 'content', json_array(json_object('type', 'text', 'text', 'None.'),
      json_object('type', 'text', 'text', concat(src, '|', hyp, '|', ref)))))))::VARCHAR AS request FROM t""",
    "judge_open_rows": f"""WITH {EVENT_RESULTS} SELECT o_orderkey AS row_id, o_orderstatus FROM orders
WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.row_id = o_orderkey AND status = 'succeeded')""",
    "judge_mean_fill": f"""WITH {EVENT_RESULTS}, t AS (
  SELECT o_orderkey AS row_id, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN coalesce(score, 0.0) END AS score,
    CASE WHEN o_orderstatus = 'F' THEN coalesce(status, 'missing') ELSE 'not_sent' END AS status
  FROM orders LEFT JOIN res ON res.row_id = o_orderkey)
SELECT row_id, o_orderstatus, round(coalesce(score, avg(score) OVER ()), 9) AS score, status, status = 'not_sent' AS is_imputed FROM t""",
    "rater_agreement": f"""WITH s AS (
  SELECT event_id AS id, 'hour/' || user_id AS metric, hour(ts)::DOUBLE AS x, value AS y FROM events
  UNION ALL SELECT event_id, 'key/' || user_id, (props::JSON ->> '$.k')::DOUBLE, value FROM events WHERE props::JSON ->> '$.k' IS NOT NULL),
{CORRELATED}
SELECT split_part(base.metric, '/', 1) AS metric, split_part(base.metric, '/', 2)::BIGINT AS rater, base.n, round(base.pearson, 9) + 0.0 AS pearson,
  round(base.spearman, 9) + 0.0 AS spearman, round(kendall, 9) + 0.0 AS kendall FROM base LEFT JOIN c USING (metric)""",
    "corpus_scores_by_source": corpus_scored("createdBy_id, score"),
    "corpus_scores_added": corpus_scored("createdBy_id"),
    "scores_of_distinct_texts": f"""WITH r AS (
  SELECT doc_id AS row_id, d.text AS targetText, b.text AS referenceText
  FROM documents d JOIN benchmark b ON b.item_id = length(d.text) % (SELECT count(*) FROM benchmark)),
{CHRF}, {EDITS}
SELECT row_id, min(row_id) OVER (PARTITION BY targetText, referenceText) AS scored_key,
  round(greatest(0.0, 1 - word_edit_rate / 100), 6) AS wer_score, round(chrfplusplus_score, 6) AS chrfplusplus_score
FROM r JOIN wer USING (row_id) JOIN chrf USING (row_id)""",
    "evaluation_resumed": f"""WITH {WER_ALONE}
SELECT row_id, round(human_score, 6) AS human_score, CASE WHEN row_id % 2 = 0 THEN 0.5 ELSE round(wer_score, 6) END AS wer_score FROM w""",
    "registered_table_metric": f"""WITH {WER_ALONE},
o AS (
  SELECT row_id, length(targetText) - avg(length(targetText)) OVER (PARTITION BY len(string_split(sourceText, ' '))) AS length_offset
  FROM r WHERE sourceText IS NOT NULL AND targetText IS NOT NULL AND referenceText IS NOT NULL)
SELECT row_id, round(human_score, 6) AS human_score, round(wer_score, 6) AS wer_score, round(length_offset, 6) + 0.0 AS length_offset_score
FROM w JOIN o USING (row_id)""",
    "sketched_scores": f"""WITH {LINE_SCORES}, t AS (SELECT metric, x FROM s UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT metric, count(x) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, true AS p01_held, true AS p25_held,
  true AS p50_held, true AS p75_held, true AS p99_held, true AS distinct_held FROM t GROUP BY metric""",
}
