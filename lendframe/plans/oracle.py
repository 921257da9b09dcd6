"""SQL oracles: for each named query, an independent DuckDB statement over
the driver tables (pre-registered as views).  Written from the definitions,
not from the Spark code; the stand-in views are the SQL of FIXTURES.md.
"""

from __future__ import annotations

from lendframe.functions.fixed import (AMOUNT_NUMBER_FORMS, ESCAPE_REPLACEMENTS, MASTER_TAGS,
                                       NA_TOKENS, TRUSTED_CURRENCIES)

ORACLES: dict[str, str] = {}

# Cut-off for the "recent" rate base: a third of the largest loan id.
RECENT_CUTOFF = "(SELECT CAST(floor(max(o_orderkey) / 3.0) AS BIGINT) FROM orders)"
DIGITS = 4

LOAN_SQL = r"""
SELECT x.*, LOAN_ID + 1000000 AS IMAGE_ID,
 CASE WHEN LOAN_ID % 13 = 0 THEN CAST(NULL AS VARCHAR(200)) ELSE concat(' To buy', chr(92), 'n', chr(92), 'u200b stock', chr(160), chr(9), chr(28), 'for <i>', TAG1, '</i>it', chr(92), chr(39), 's  ', chr(92), chr(92), 'shop', chr(92), 'xad. ', 'ÉTÉ ') END AS LOAN_USE FROM (
SELECT b.*,
 CASE WHEN LOAN_ID % 5 < 4 THEN AMT END AS LOAN_AMOUNT,
 CASE WHEN LOAN_ID % 11 = 0 THEN CAST(NULL AS VARCHAR(200))
      WHEN LOAN_ID % 2 = 0 THEN concat('#', TAG1, ', user_favorite, #', TAG1)
      ELSE concat(' #Repeat Borrower,#', TAG1, ',not in master') END AS TAGS,
 CASE WHEN LOAN_ID % 4 = 0 THEN CAST(NULL AS VARCHAR(200))
      WHEN LOAN_ID % 4 = 1 THEN concat('<b>Hello</b>  we are 12 people. She asks for ', CURRENCY, ' ', QC, ' to buy stock. Thanks')
      WHEN LOAN_ID % 4 = 2 THEN concat('Needs ', QS, ' ', CURRENCY, '.<br />She repays in 24 months. Last loan was ', CURRENCY, ' 100.50 only')
      ELSE 'No amount is stated here. Only words' END AS DESCRIPTION_TRANSLATED,
 concat('Pide ', CURRENCY, QS) AS DESCRIPTION
FROM (
 SELECT o.o_orderkey AS LOAN_ID, o.o_totalprice AS AMT,
  c.c_mktsegment AS SECTOR_NAME, o.o_orderpriority AS ACTIVITY_NAME, r.r_name AS COUNTRY_CODE,
  CASE WHEN n.n_nationkey % 7 = 6 THEN CAST(NULL AS VARCHAR(50)) ELSE n.n_name END AS COUNTRY_NAME,
  c.c_name AS TOWN_NAME,
  CASE o.o_orderstatus WHEN 'O' THEN 'shared' WHEN 'F' THEN 'not shared' END AS CURRENCY_POLICY,
  CASE o.o_orderstatus WHEN 'O' THEN CAST(0.1 AS DOUBLE) WHEN 'F' THEN CAST(0 AS DOUBLE) END AS CURRENCY_EXCHANGE_COVERAGE_RATE,
  CASE n.n_nationkey % 5 WHEN 0 THEN 'PHP' WHEN 1 THEN 'KES' WHEN 2 THEN 'UGX' WHEN 3 THEN 'USD' ELSE 'XOF' END AS CURRENCY,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'Spanish' ELSE 'French' END AS ORIGINAL_LANGUAGE,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'bullet' ELSE 'irregular' END AS REPAYMENT_INTERVAL,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 'direct' ELSE 'field_partner' END AS DISTRIBUTION_MODEL,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Parent' WHEN 'MACHINERY' THEN 'Technology' WHEN 'FURNITURE' THEN 'Repair Renew Replace' WHEN 'BUILDING' THEN 'Biz Durable Asset' ELSE 'Eco-friendly' END AS TAG1,
  CAST(q AS VARCHAR(20)) AS QS,
  CASE WHEN q >= 1000000 THEN concat(CAST(CAST(floor(q/1000000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(CAST(floor(q/1000) AS BIGINT) % 1000 AS VARCHAR(20)),3,'0'), ',', lpad(CAST(q % 1000 AS VARCHAR(20)),3,'0'))
       ELSE concat(CAST(CAST(floor(q/1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(q % 1000 AS VARCHAR(20)),3,'0')) END AS QC
 FROM (SELECT oo.*, CAST(floor(oo.o_totalprice * CASE nn.n_nationkey % 5 WHEN 0 THEN 50 WHEN 1 THEN 110 WHEN 2 THEN 360 WHEN 3 THEN 1 ELSE 55 END) AS BIGINT) AS q
       FROM orders oo JOIN customer cc ON oo.o_custkey = cc.c_custkey JOIN nation nn ON cc.c_nationkey = nn.n_nationkey) o
 JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey
) b
) x
"""

VIEWS = {
    "loan": LOAN_SQL,
    "train": "SELECT * FROM loan WHERE LOAN_AMOUNT IS NOT NULL",
    "test": "SELECT * FROM loan WHERE LOAN_AMOUNT IS NULL",
    "predictions": """SELECT n.n_nationkey AS model_id, l.LOAN_ID,
               l.AMT * (0.8 + 0.02 * n.n_nationkey + 0.01 * (l.LOAN_ID % 7)) AS LOAN_AMOUNT
             FROM loan l CROSS JOIN nation n WHERE n.n_nationkey < 16""",
    "metrics_log": """SELECT user_id % 5 AS epoch,
               row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS step, value AS mae
             FROM events""",
    "images": """SELECT IMAGE_ID, concat('data/images/', CAST(IMAGE_ID AS VARCHAR(20)), '.jpg') AS path
             FROM loan WHERE LOAN_ID % 6 <> 0""",
    "detections": "SELECT l_orderkey + 1000000 AS IMAGE_ID, l_linenumber AS box_id FROM lineitem",
    "shift": """SELECT vec_id, vec_id % 5 = 4 AS is_test, CAST(embedding AS DOUBLE[]) AS x,
               CAST(label AS DOUBLE) AS y FROM embeddings""",
}

# Order in which views may depend on one another.
_VIEW_ORDER = ["loan", "train", "test", "predictions", "metrics_log", "images", "detections", "shift"]


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (and what those need)."""
    need = set(names)
    if need & {"train", "test", "predictions", "images"}:
        need.add("loan")
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _VIEW_ORDER if n in need]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def oracle(name: str, *views: str):
    def deco(fn):
        ORACLES[name] = with_views(fn(), *views)
        return fn
    return deco


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def amount_pattern_sql(cur: str = "CURRENCY") -> str:
    parts = []
    for form in AMOUNT_NUMBER_FORMS:
        parts += [cur, f"' ?({form}) |'"]
    for i, form in enumerate(AMOUNT_NUMBER_FORMS):
        parts += [f"' ({form}) ?'", cur]
        if i < len(AMOUNT_NUMBER_FORMS) - 1:
            parts.append("'|'")
    return "concat(" + ", ".join(parts) + ")"


DESC_TEXT = "coalesce(DESCRIPTION_TRANSLATED, DESCRIPTION)"
SENTENCES_V2 = f"list_transform(string_split_regex(replace({DESC_TEXT}, '<br />', ' '), '[.] '), lambda s: s || ' ')"
SENTENCES_V1 = f"string_split({DESC_TEXT}, '.')"

# CTE fragments shared by several oracles.
LOCAL_V2 = f"""
sent2 AS (SELECT LOAN_ID, CURRENCY, unnest({SENTENCES_V2}) AS sentence FROM loan),
m2 AS (SELECT LOAN_ID, unnest(regexp_extract_all(sentence, {amount_pattern_sql()}, 0)) AS m
       FROM sent2 WHERE contains(sentence, CURRENCY)),
local2 AS (SELECT l.LOAN_ID, l.CURRENCY,
             max(CAST(regexp_replace(m2.m, '[^0-9.]', '', 'g') AS DOUBLE)) AS LOAN_AMOUNT_LOCAL
           FROM loan l LEFT JOIN m2 ON l.LOAN_ID = m2.LOAN_ID GROUP BY l.LOAN_ID, l.CURRENCY),
rate2 AS (SELECT lo.CURRENCY, median(lo.LOAN_AMOUNT_LOCAL / t.LOAN_AMOUNT) AS rate
          FROM local2 lo JOIN train t ON lo.LOAN_ID = t.LOAN_ID
          WHERE lo.LOAN_ID > {RECENT_CUTOFF} GROUP BY lo.CURRENCY),
desc2 AS (SELECT lo.LOAN_ID, lo.CURRENCY, lo.LOAN_AMOUNT_LOCAL / r.rate AS LOAN_AMOUNT_DESC
          FROM local2 lo LEFT JOIN rate2 r ON lo.CURRENCY = r.CURRENCY)"""

ENSEMBLE = """
ens AS (SELECT LOAN_ID,
          CASE WHEN count(LOAN_AMOUNT) = (SELECT count(DISTINCT model_id) FROM predictions)
               THEN avg(LOAN_AMOUNT) END AS LOAN_AMOUNT
        FROM predictions GROUP BY LOAN_ID)"""


def _cte(*fragments: str) -> str:
    return ",\n".join(f.strip() for f in fragments)


@oracle("corrected_submission", "train", "test", "predictions")
def _corrected_submission():
    return f""", {_cte(LOCAL_V2, ENSEMBLE)}
SELECT t.LOAN_ID,
  round(coalesce(CASE WHEN t.CURRENCY IN ({_sql_list(TRUSTED_CURRENCIES)}) THEN d.LOAN_AMOUNT_DESC END,
                 e.LOAN_AMOUNT), {DIGITS}) AS LOAN_AMOUNT
FROM test t LEFT JOIN ens e ON t.LOAN_ID = e.LOAN_ID LEFT JOIN desc2 d ON t.LOAN_ID = d.LOAN_ID"""


# ---------------------------------------------------------------------------
# Helpers for SQL text
# ---------------------------------------------------------------------------

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Python-equivalent whitespace for RE2 (\s there is ASCII only).
WS_RE2 = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def norm_sql(expr: str, lower: bool = True) -> str:
    e = expr
    for old, new in ESCAPE_REPLACEMENTS:
        e = f"replace({e}, {lit(old)}, {lit(new)})"
    e = f"regexp_replace({e}, '<[^\\n]*?>', '', 'g')"
    e = f"regexp_replace({e}, '{WS_RE2}+', ' ', 'g')"
    e = f"trim({e})"
    return f"lower({e})" if lower else e


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


TAG_LIST = (f"list_transform(string_split(coalesce(TAGS, 'NA'), ','), "
            f"lambda t: lower(replace({strip_sql('t')}, '#', '')))")


def flag_name(tag: str) -> str:
    import re
    return "tag_" + re.sub(r"[^a-z0-9]+", "_", tag).strip("_")


def col_name(variable: str) -> str:
    import re
    return re.sub(r"\s*>\s*", "__", variable)


def category_sql(variable: str) -> str:
    """Text value of a (possibly composite) category variable."""
    from lendframe.functions.fixed import COMPOSITES
    if variable in COMPOSITES:
        parts = []
        for p in COMPOSITES[variable]:
            if p == "CURRENCY_EXCHANGE_COVERAGE_RATE":
                parts.append(f"coalesce(CAST({p} AS VARCHAR), 'nan')")
            else:
                parts.append(p)
        return " || ' > ' || ".join(parts)
    return f"CAST({variable} AS VARCHAR)"


def long_sql(source: str, variables) -> str:
    return "\nUNION ALL ".join(
        f"SELECT LOAN_ID, {i + 1} AS pos, {lit(v)} AS variable, {category_sql(v)} AS value FROM {source}"
        for i, v in enumerate(variables))


def dictionary_ctes(variables) -> str:
    return f"""
dlong AS ({long_sql('train', variables)}),
dfirst AS (SELECT pos, variable, value, min(LOAN_ID) AS first_id FROM dlong GROUP BY pos, variable, value),
dict AS (SELECT row_number() OVER (ORDER BY pos, first_id, value NULLS FIRST) AS id, variable, value FROM dfirst),
ulong AS ({long_sql('loan', variables)}),
enc AS (SELECT u.LOAN_ID, u.variable, coalesce(d.id, 0) AS id
        FROM ulong u LEFT JOIN dict d ON u.variable = d.variable AND u.value IS NOT DISTINCT FROM d.value)"""


# ---------------------------------------------------------------------------
# Amounts
# ---------------------------------------------------------------------------

LOCAL_V1 = f"""
sent1 AS (SELECT LOAN_ID, CURRENCY, unnest({SENTENCES_V1}) AS sentence FROM loan),
m1 AS (SELECT LOAN_ID, unnest(regexp_extract_all(replace(sentence, ',', ''), '([0-9]+)', 1)) AS m
       FROM sent1 WHERE contains(sentence, CURRENCY)),
local1 AS (SELECT l.LOAN_ID, l.CURRENCY, max(CAST(m1.m AS DOUBLE)) AS LOAN_AMOUNT_LOCAL
           FROM loan l LEFT JOIN m1 ON l.LOAN_ID = m1.LOAN_ID GROUP BY l.LOAN_ID, l.CURRENCY),
rate1 AS (SELECT lo.CURRENCY, median(lo.LOAN_AMOUNT_LOCAL / t.LOAN_AMOUNT) AS rate
          FROM local1 lo JOIN train t ON lo.LOAN_ID = t.LOAN_ID GROUP BY lo.CURRENCY),
desc1 AS (SELECT lo.LOAN_ID, lo.LOAN_AMOUNT_LOCAL / r.rate AS LOAN_AMOUNT_DESC
          FROM local1 lo LEFT JOIN rate1 r ON lo.CURRENCY = r.CURRENCY),
ystats AS (SELECT avg(ln(LOAN_AMOUNT)) AS m, stddev_pop(ln(LOAN_AMOUNT)) AS s FROM train),
feat1 AS (SELECT d.LOAN_ID, (ln(d.LOAN_AMOUNT_DESC + 1) - y.m) / y.s AS z FROM desc1 d, ystats y)"""


@oracle("extract_amount", "loan")
def _extract_amount():
    return f""", {_cte(LOCAL_V2.split('rate2 AS')[0].rstrip().rstrip(','))}
SELECT LOAN_ID, CURRENCY, round(LOAN_AMOUNT_LOCAL, {DIGITS}) AS LOAN_AMOUNT_LOCAL FROM local2"""


@oracle("extract_amount_v1", "loan")
def _extract_amount_v1():
    return f""", {_cte(LOCAL_V1.split('rate1 AS')[0].rstrip().rstrip(','))}
SELECT LOAN_ID, CURRENCY, round(LOAN_AMOUNT_LOCAL, {DIGITS}) AS LOAN_AMOUNT_LOCAL FROM local1"""


@oracle("median_rate", "train")
def _median_rate():
    return f""", {_cte(LOCAL_V1)}
SELECT CURRENCY, round(rate, 6) AS rate FROM rate1"""


@oracle("median_rate_recent", "train")
def _median_rate_recent():
    return f""", {_cte(LOCAL_V2)}
SELECT CURRENCY, round(rate, 6) AS rate FROM rate2"""


@oracle("convert_usd", "train")
def _convert_usd():
    return f""", {_cte(LOCAL_V2)}
SELECT LOAN_ID, CURRENCY, round(LOAN_AMOUNT_DESC, {DIGITS}) AS LOAN_AMOUNT_DESC FROM desc2"""


@oracle("amount_feature", "train")
def _amount_feature():
    return f""", {_cte(LOCAL_V1)}
SELECT LOAN_ID, round(coalesce(z, 0), 6) AS LOAN_AMOUNT_DESC_LOG_Z,
       CASE WHEN z IS NULL THEN 1 ELSE 0 END AS LOAN_AMOUNT_DESC_LOG_Z_isna FROM feat1"""


@oracle("currency_whitelist", "train", "test")
def _currency_whitelist():
    return f""", {_cte(LOCAL_V2)}
SELECT t.LOAN_ID, d.CURRENCY,
  round(CASE WHEN d.CURRENCY IN ({_sql_list(TRUSTED_CURRENCIES)}) THEN d.LOAN_AMOUNT_DESC END, {DIGITS})
    AS LOAN_AMOUNT_DESC
FROM test t LEFT JOIN desc2 d ON t.LOAN_ID = d.LOAN_ID"""


@oracle("ensemble_mean", "predictions")
def _ensemble_mean():
    return f""", {_cte(ENSEMBLE)}
SELECT LOAN_ID, round(LOAN_AMOUNT, {DIGITS}) AS LOAN_AMOUNT FROM ens"""


# ---------------------------------------------------------------------------
# Sentences
# ---------------------------------------------------------------------------

def _sentence_rows(split_expr: str) -> str:
    return f"""
SELECT LOAN_ID, CURRENCY, CAST(unnest(range(len(s))) AS INTEGER) AS sentence_no, unnest(s) AS sentence
FROM (SELECT LOAN_ID, CURRENCY, {split_expr} AS s FROM loan)"""


@oracle("sentences_v1", "loan")
def _sentences_v1():
    return _sentence_rows(SENTENCES_V1)


@oracle("sentences", "loan")
def _sentences():
    return _sentence_rows(SENTENCES_V2)


@oracle("sentences_with_currency", "loan")
def _sentences_with_currency():
    return f"SELECT * FROM ({_sentence_rows(SENTENCES_V2)}) WHERE contains(sentence, CURRENCY)"


# ---------------------------------------------------------------------------
# Sources and text
# ---------------------------------------------------------------------------

_LOAN_COLUMNS = ["LOAN_ID", "LOAN_AMOUNT", "DESCRIPTION", "DESCRIPTION_TRANSLATED", "LOAN_USE", "IMAGE_ID",
                 "ORIGINAL_LANGUAGE", "SECTOR_NAME", "ACTIVITY_NAME", "COUNTRY_CODE", "COUNTRY_NAME",
                 "TOWN_NAME", "CURRENCY_POLICY", "CURRENCY_EXCHANGE_COVERAGE_RATE", "CURRENCY",
                 "REPAYMENT_INTERVAL", "DISTRIBUTION_MODEL", "TAGS"]
_NUMERIC = {"LOAN_ID", "LOAN_AMOUNT", "IMAGE_ID", "CURRENCY_EXCHANGE_COVERAGE_RATE"}


@oracle("scan_project", "loan")
def _scan_project():
    cols = []
    for c in _LOAN_COLUMNS:
        if c == "CURRENCY_EXCHANGE_COVERAGE_RATE":
            cols.append(f"round({c}, {DIGITS}) AS {c}")
        elif c in _NUMERIC:
            cols.append(c)
        else:
            cols.append(f"CASE WHEN {c} IN ({_sql_list(NA_TOKENS)}) THEN NULL ELSE {c} END AS {c}")
    return "SELECT " + ", ".join(cols) + " FROM loan"


# Written and read back, the prediction sets average to the same means.
ORACLES["ensemble_from_files"] = ORACLES["ensemble_mean"]

# The CSV round trip reads back exactly what the projection delivers.
ORACLES["scan_csv"] = ORACLES["scan_project"]


@oracle("coalesce_description", "loan")
def _coalesce_description():
    return f"SELECT LOAN_ID, {DESC_TEXT} AS DESCRIPTION_TRANSLATED FROM loan"


@oracle("normalize_text", "loan")
def _normalize_text():
    return (f"SELECT LOAN_ID, {norm_sql(DESC_TEXT)} AS DESCRIPTION_TRANSLATED, "
            f"{norm_sql('LOAN_USE')} AS LOAN_USE FROM loan")


@oracle("normalize_text_keep_case", "loan")
def _normalize_text_keep_case():
    return (f"SELECT LOAN_ID, {norm_sql(DESC_TEXT, False)} AS DESCRIPTION_TRANSLATED, "
            f"{norm_sql('LOAN_USE', False)} AS LOAN_USE FROM loan")


@oracle("token_window", "loan")
def _token_window():
    return f"""
, norm AS (SELECT LOAN_ID, 'DESCRIPTION_TRANSLATED' AS field, {norm_sql(DESC_TEXT)} AS text FROM loan
           UNION ALL SELECT LOAN_ID, 'LOAN_USE' AS field, {norm_sql('LOAN_USE')} AS text FROM loan),
tok AS (SELECT LOAN_ID, field, list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '') AS w
        FROM norm)
SELECT LOAN_ID, field, CAST(least(len(w), 256) AS BIGINT) AS n_tokens,
       CAST(256 - least(len(w), 256) AS BIGINT) AS n_pad,
       CASE WHEN len(w) > 0 THEN w[least(len(w), 256)] END AS last_token
FROM tok"""


# ---------------------------------------------------------------------------
# Categories
# ---------------------------------------------------------------------------

def _words_sql(expr: str) -> str:
    return f"list_filter(string_split(coalesce({norm_sql(expr)}, ''), ' '), lambda w: w <> '')"


TOKENS = f"""
fields AS (SELECT LOAN_ID, LOAN_AMOUNT, 'DESCRIPTION_TRANSLATED' AS field, {_words_sql(DESC_TEXT)} AS tokens FROM loan
           UNION ALL SELECT LOAN_ID, LOAN_AMOUNT, 'LOAN_USE' AS field, {_words_sql('LOAN_USE')} AS tokens FROM loan),
voc AS (SELECT row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id, token, n FROM (
          SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM fields WHERE LOAN_AMOUNT IS NOT NULL) GROUP BY token))"""


@oracle("vocabulary", "loan")
def _vocabulary():
    return f""", {_cte(TOKENS)}
SELECT token_id, token, n FROM voc"""


@oracle("token_ids", "loan")
def _token_ids():
    return f""", {_cte(TOKENS)},
each AS (SELECT LOAN_ID, field, unnest(tokens[1:256]) AS token, generate_subscripts(tokens[1:256], 1) AS pos FROM fields),
ids AS (SELECT LOAN_ID, field, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM each LEFT JOIN voc USING (token) GROUP BY LOAN_ID, field),
padded AS (SELECT f.LOAN_ID, f.field, coalesce(ids, []) AS ids FROM fields f LEFT JOIN ids i ON i.LOAN_ID = f.LOAN_ID AND i.field = f.field)
SELECT LOAN_ID, field, array_to_string(list_concat(ids, list_transform(range(256 - len(ids)), lambda i: 0)), ' ') AS input_ids,
       concat(repeat('1', len(ids)), repeat('0', 256 - len(ids))) AS attention_mask FROM padded"""


@oracle("epoch_batches", "train")
def _epoch_batches():
    return """, each AS (SELECT CAST(epoch AS INTEGER) AS epoch, LOAN_ID FROM train, (SELECT unnest([1, 2, 3]) AS epoch) e),
placed AS (SELECT epoch, LOAN_ID, row_number() OVER (PARTITION BY epoch
             ORDER BY md5('0-' || CAST(epoch AS VARCHAR) || '-' || CAST(LOAN_ID AS VARCHAR)), LOAN_ID) - 1 AS nth FROM each)
SELECT epoch, nth // 128 AS batch, nth % 128 AS slot, LOAN_ID FROM placed"""


@oracle("prediction_batches", "test")
def _prediction_batches():
    return """, placed AS (SELECT LOAN_ID, row_number() OVER (ORDER BY LOAN_ID) - 1 AS nth FROM test)
SELECT nth // 128 AS batch, nth % 128 AS slot, LOAN_ID FROM placed"""


@oracle("composite_categories", "loan")
def _composite_categories():
    from lendframe.functions.fixed import COMPOSITES
    cols = ", ".join(f"{category_sql(v)} AS {col_name(v)}" for v in COMPOSITES)
    return f"SELECT LOAN_ID, {cols} FROM loan"


@oracle("category_dictionary", "train")
def _category_dictionary():
    from lendframe.functions.fixed import CATEGORY_VARIABLES_10
    return f""", {_cte(dictionary_ctes(CATEGORY_VARIABLES_10))}
SELECT id, variable, value FROM dict"""


@oracle("dictionary_size", "train")
def _dictionary_size():
    from lendframe.functions.fixed import CATEGORY_VARIABLES_10
    return f""", {_cte(dictionary_ctes(CATEGORY_VARIABLES_10))}
SELECT count(*) + 1 AS num_embeddings FROM dict"""


@oracle("category_encode", "train")
def _category_encode():
    from lendframe.functions.fixed import CATEGORY_VARIABLES_10
    return f""", {_cte(dictionary_ctes(CATEGORY_VARIABLES_10))}
SELECT LOAN_ID, variable, id FROM enc"""


@oracle("category_encode_wide", "train")
def _category_encode_wide():
    from lendframe.functions.fixed import CATEGORY_VARIABLES_9
    cols = ", ".join(f"max(CASE WHEN variable = {lit(v)} THEN id END) AS {col_name(v)}"
                     for v in sorted(CATEGORY_VARIABLES_9))
    return f""", {_cte(dictionary_ctes(CATEGORY_VARIABLES_9))}
SELECT LOAN_ID, {cols} FROM enc GROUP BY LOAN_ID"""


# ---------------------------------------------------------------------------
# Tags
# ---------------------------------------------------------------------------

@oracle("tags_onehot", "loan")
def _tags_onehot():
    flags = ", ".join(f"CAST(list_contains(tags, {lit(t)}) AS DOUBLE) AS {flag_name(t)}" for t in MASTER_TAGS)
    return f"SELECT LOAN_ID, {flags} FROM (SELECT LOAN_ID, {TAG_LIST} AS tags FROM loan)"


@oracle("tag_frequency", "loan")
def _tag_frequency():
    return f"""SELECT tag, count(*) AS n_loans
FROM (SELECT unnest(list_distinct({TAG_LIST})) AS tag FROM loan) GROUP BY tag"""


# ---------------------------------------------------------------------------
# Target
# ---------------------------------------------------------------------------

@oracle("target_stats", "train")
def _target_stats():
    return """SELECT round(avg(ln(LOAN_AMOUNT)), 9) AS y_log_mean, round(stddev_pop(ln(LOAN_AMOUNT)), 9) AS y_log_std,
  count(LOAN_AMOUNT) AS n_train FROM train"""


@oracle("target_zscore", "train")
def _target_zscore():
    return """, ys AS (SELECT avg(ln(LOAN_AMOUNT)) AS m, stddev_pop(ln(LOAN_AMOUNT)) AS s FROM train)
SELECT LOAN_ID, round((ln(LOAN_AMOUNT) - m) / s, 6) AS y_log_z FROM train, ys"""


@oracle("denormalize_roundtrip", "train")
def _denormalize_roundtrip():
    return f""", ys AS (SELECT avg(ln(LOAN_AMOUNT)) AS m, stddev_pop(ln(LOAN_AMOUNT)) AS s FROM train),
rt AS (SELECT LOAN_ID, LOAN_AMOUNT AS y, exp(((ln(LOAN_AMOUNT) - m) / s) * s + m) AS back FROM train, ys)
SELECT LOAN_ID, round(back, {DIGITS}) AS LOAN_AMOUNT,
       CASE WHEN abs(back - y) <= y * 1e-9 THEN 1 ELSE 0 END AS exact FROM rt"""


@oracle("union_train_test", "train", "test")
def _union_train_test():
    return """SELECT LOAN_ID, CURRENCY, LOAN_AMOUNT, 1 AS is_train FROM train
UNION ALL SELECT LOAN_ID, CURRENCY, CAST(NULL AS DOUBLE) AS LOAN_AMOUNT, 0 AS is_train FROM test"""


# ---------------------------------------------------------------------------
# Metrics and split
# ---------------------------------------------------------------------------

@oracle("mae_by_model", "train", "predictions")
def _mae_by_model():
    return f"""SELECT p.model_id, round(avg(abs(t.LOAN_AMOUNT - p.LOAN_AMOUNT)), {DIGITS}) AS mae
FROM predictions p JOIN train t ON p.LOAN_ID = t.LOAN_ID GROUP BY p.model_id"""


@oracle("running_mae", "metrics_log")
def _running_mae():
    return """, x AS (SELECT epoch, step, CAST(round(mae * 100) AS BIGINT) AS c FROM metrics_log),
r AS (SELECT epoch, step, count(*) OVER w AS n, sum(c) OVER w AS s1, sum(c * c) OVER w AS s2
      FROM x WINDOW w AS (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT epoch, step, round(CAST(s1 AS DOUBLE) / n / 100, 6) AS mae_mean,
       round(sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE)) / n / 100, 6) AS mae_std
FROM r WHERE (step + 1) % 10 = 0"""


def md5_bucket_sql(key: str, buckets: str, seed: int = 0) -> str:
    return f"(CAST('0x' || substr(md5('{seed}-' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {buckets})"


@oracle("holdout_split", "train")
def _holdout_split():
    return f"""SELECT LOAN_ID, CASE WHEN {md5_bucket_sql('LOAN_ID', '100')} >= 80 THEN 1 ELSE 0 END AS is_holdout
FROM train"""


# ---------------------------------------------------------------------------
# Images and additional features
# ---------------------------------------------------------------------------

PRESENCE = """
pres AS (SELECT l.LOAN_ID, l.IMAGE_ID, CASE WHEN i.IMAGE_ID IS NULL THEN 0 ELSE 1 END AS has_image
         FROM loan l LEFT JOIN (SELECT DISTINCT IMAGE_ID FROM images) i ON l.IMAGE_ID = i.IMAGE_ID),
boxes AS (SELECT IMAGE_ID, count(*) AS n FROM detections GROUP BY IMAGE_ID),
faces AS (SELECT p.LOAN_ID, CAST(CASE WHEN p.has_image = 1 THEN coalesce(b.n, 0) ELSE 0 END AS INTEGER) AS NUM_FACES
          FROM pres p LEFT JOIN boxes b ON p.IMAGE_ID = b.IMAGE_ID)"""


@oracle("image_presence", "images")
def _image_presence():
    return f""", {_cte(PRESENCE)}
SELECT LOAN_ID, IMAGE_ID, has_image FROM pres"""


@oracle("detection_count", "images", "detections")
def _detection_count():
    return f""", {_cte(PRESENCE)}
SELECT LOAN_ID, NUM_FACES FROM faces"""


@oracle("join_additional_features", "train", "images", "detections")
def _join_additional_features():
    return f""", {_cte(PRESENCE, LOCAL_V1)}
SELECT l.LOAN_ID, f.NUM_FACES, round(coalesce(a.z, 0), 6) AS LOAN_AMOUNT_DESC_LOG_Z,
       CASE WHEN a.z IS NULL THEN 1 ELSE 0 END AS LOAN_AMOUNT_DESC_LOG_Z_isna
FROM loan l LEFT JOIN faces f ON l.LOAN_ID = f.LOAN_ID LEFT JOIN feat1 a ON l.LOAN_ID = a.LOAN_ID"""


# ---------------------------------------------------------------------------
# Covariate shift: batches of 128 training rows in buckets of ~256 rows
# ---------------------------------------------------------------------------

def _sq(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}.x) + 1), "
            f"lambda k: ({a}.x[k] - {b}.x[k]) * ({a}.x[k] - {b}.x[k])))")


SHIFT_BATCHES = f"""
nb AS (SELECT CAST(greatest(1, floor(count(*) FILTER (WHERE NOT is_test) / 256)) AS BIGINT) AS a,
       CAST(greatest(1, floor(count(*) FILTER (WHERE is_test) / 256)) AS BIGINT) AS b FROM shift),
b0 AS (SELECT s.*, {md5_bucket_sql('vec_id', 'CASE WHEN is_test THEN b ELSE a END')} AS bucket FROM shift s, nb),
bt AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY is_test, bucket ORDER BY vec_id) - 1) / 128) AS BIGINT)
         AS batch FROM b0),
tr AS (SELECT * FROM bt WHERE NOT is_test),
te AS (SELECT * FROM bt WHERE is_test),
nbuckets AS (SELECT greatest(a, b) AS g FROM nb),
links AS (SELECT u.bucket, u.i % u.k AS batch, u.te_bucket, u.i % u.m AS te_batch FROM (
  SELECT p.bucket, p.te_bucket, k, m, unnest(range(greatest(k, m))) AS i FROM
    (SELECT x.g % nb.a AS bucket, x.g % nb.b AS te_bucket FROM (SELECT unnest(range(g)) AS g FROM nbuckets) x, nb) p
    JOIN (SELECT bucket, max(batch) + 1 AS k FROM tr GROUP BY bucket) z1 ON z1.bucket = p.bucket
    JOIN (SELECT bucket, max(batch) + 1 AS m FROM te GROUP BY bucket) z2 ON z2.bucket = p.te_bucket) u),
ntr AS (SELECT bucket, batch, count(*) AS n_tr FROM tr GROUP BY bucket, batch),
tt AS (SELECT a.bucket, a.batch, a.vec_id AS i, c.vec_id AS j, {_sq('a', 'c')} AS d2
       FROM tr a JOIN tr c ON a.bucket = c.bucket AND a.batch = c.batch),
width AS (SELECT bucket, batch, quantile_cont(sqrt(d2), 0.01) AS w FROM tt WHERE i < j GROUP BY bucket, batch),
kte AS (SELECT a.vec_id, a.bucket, a.batch, exp(-w.w * {_sq('a', 'c')}) AS kv
        FROM tr a JOIN links z ON a.bucket = z.bucket AND a.batch = z.batch
        JOIN te c ON c.bucket = z.te_bucket AND c.batch = z.te_batch
        JOIN width w ON w.bucket = a.bucket AND w.batch = a.batch),
ktr AS (SELECT t.i AS vec_id, avg(exp(-w.w * t.d2)) AS mk FROM tt t
        JOIN width w ON w.bucket = t.bucket AND w.batch = t.batch GROUP BY t.i),
rowk AS (SELECT k.vec_id, k.bucket, k.batch, sum(k.kv) AS sk, avg(k.kv) AS mte, count(*) AS n_te
         FROM kte k GROUP BY k.vec_id, k.bucket, k.batch),
ratio AS (SELECT t.vec_id, t.bucket, t.batch, r.sk, r.n_te,
            least(greatest(r.mte / kt.mk, 0.0), {50.0}) AS q
          FROM tr t LEFT JOIN rowk r ON t.vec_id = r.vec_id LEFT JOIN ktr kt ON t.vec_id = kt.vec_id),
weights AS (SELECT ra.vec_id, ra.bucket, ra.batch,
              -(CAST(n.n_tr AS DOUBLE) / ra.n_te) * ra.sk AS kappa,
              CASE WHEN ra.q IS NULL THEN 1.0
                   ELSE ra.q * n.n_tr / sum(ra.q) OVER (PARTITION BY ra.bucket, ra.batch) END AS weight
            FROM ratio ra JOIN ntr n ON ra.bucket = n.bucket AND ra.batch = n.batch)"""


@oracle("kernel_width", "shift")
def _kernel_width():
    return f""", {_cte(SHIFT_BATCHES)}
SELECT n.bucket, n.batch, round(w.w, 6) AS kernel_width
FROM ntr n LEFT JOIN width w ON n.bucket = w.bucket AND n.batch = w.batch"""


@oracle("kernel_row_sums", "shift")
def _kernel_row_sums():
    return f""", {_cte(SHIFT_BATCHES)}
SELECT vec_id, round(kappa, 6) AS kappa FROM weights"""


@oracle("density_ratio", "shift")
def _density_ratio():
    return f""", {_cte(SHIFT_BATCHES)}
SELECT vec_id, round(weight, 6) AS weight FROM weights"""


@oracle("weighted_loss", "shift")
def _weighted_loss():
    return f""", {_cte(SHIFT_BATCHES)},
p AS (SELECT avg(y) AS p FROM shift WHERE NOT is_test)
SELECT w.bucket, w.batch, round(avg(w.weight * (p.p - t.y) * (p.p - t.y)), 6) AS weighted_loss
FROM weights w JOIN tr t ON w.vec_id = t.vec_id, p GROUP BY w.bucket, w.batch"""


@oracle("feature_vector_width", "train")
def _feature_vector_width():
    from lendframe.functions.fixed import CATEGORY_VARIABLES_10
    return f""", {_cte(dictionary_ctes(CATEGORY_VARIABLES_10))},
cb AS (SELECT sum(w) AS category_block FROM (SELECT variable, count(*) + 2 AS w FROM dict GROUP BY variable))
SELECT CAST(category_block AS BIGINT) AS category_block, CAST(2048 AS BIGINT) AS text_block,
       CAST({len(MASTER_TAGS)} AS BIGINT) AS tag_block, CAST(3 AS BIGINT) AS numeric_block,
       CAST(category_block + 2048 + {len(MASTER_TAGS)} + 3 AS BIGINT) AS width FROM cb"""


# ---------------------------------------------------------------------------
# Files written and read back
# ---------------------------------------------------------------------------

ORACLES["image_files"] = ORACLES["image_presence"]
ORACLES["feature_csv_join"] = ORACLES["detection_count"]


@oracle("ensemble_by_file_name", "test", "predictions")
def _ensemble_by_file_name():
    return f""", {_cte(ENSEMBLE)}
SELECT t.LOAN_ID, round(e.LOAN_AMOUNT, {DIGITS}) AS LOAN_AMOUNT FROM test t LEFT JOIN ens e ON t.LOAN_ID = e.LOAN_ID"""


@oracle("epoch_outputs", "predictions")
def _epoch_outputs():
    return f"""SELECT CAST(model_id AS INTEGER) AS epoch, LOAN_ID, round(CASE WHEN model_id = 9 THEN 2 ELSE 1 END * LOAN_AMOUNT, {DIGITS}) AS LOAN_AMOUNT
FROM predictions WHERE model_id BETWEEN 8 AND 10"""


@oracle("training_metrics", "train", "predictions")
def _training_metrics():
    return f"""SELECT CAST(p.model_id AS INTEGER) AS epoch, count(t.LOAN_AMOUNT) AS n, round(avg(abs(t.LOAN_AMOUNT - p.LOAN_AMOUNT)), {DIGITS}) AS mae,
  round(stddev_pop(abs(t.LOAN_AMOUNT - p.LOAN_AMOUNT)), {DIGITS}) AS std
FROM predictions p LEFT JOIN train t ON p.LOAN_ID = t.LOAN_ID WHERE p.model_id BETWEEN 8 AND 10 GROUP BY p.model_id"""


ORACLES["metrics_log"] = f"SELECT m.*, r.run FROM ({ORACLES['running_mae']}) m, (SELECT unnest(['first', 'second']) AS run) r"


@oracle("scan_csv_rejects", "loan")
def _scan_csv_rejects():
    return f"""SELECT CASE WHEN LOAN_ID % 17 <> 0 AND LOAN_ID % 19 = 0 THEN concat('x', LOAN_ID) ELSE CAST(LOAN_ID AS VARCHAR) END AS record, reason,
  CASE WHEN reason = 'ok' THEN LOAN_ID END AS LOAN_ID, CASE WHEN reason = 'ok' THEN round(LOAN_AMOUNT, {DIGITS}) END AS LOAN_AMOUNT
FROM (SELECT *, CASE WHEN LOAN_ID % 17 = 0 THEN 'fields' WHEN LOAN_ID % 19 = 0 THEN 'LOAN_ID' WHEN LOAN_ID % 23 = 0 THEN 'LOAN_AMOUNT'
                     WHEN LOAN_ID % 29 = 0 THEN 'fields' ELSE 'ok' END AS reason FROM loan)"""


@oracle("median_rate_sketched", "train")
def _median_rate_sketched():
    return f""", {_cte(LOCAL_V1)}
SELECT lo.CURRENCY, count(lo.LOAN_AMOUNT_LOCAL / t.LOAN_AMOUNT) AS n, CAST(1 AS INTEGER) AS within
FROM local1 lo JOIN train t ON lo.LOAN_ID = t.LOAN_ID GROUP BY lo.CURRENCY HAVING n > 0"""


@oracle("encode_text", "loan")
def _encode_text():
    return f""", x AS (SELECT LOAN_ID, coalesce({norm_sql(DESC_TEXT)}, '') AS t FROM loan)
SELECT LOAN_ID, length(t) AS n_chars, CAST(len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS BIGINT) AS n_words,
       length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, CAST(len(list_distinct(string_split(t, ''))) AS BIGINT) AS n_distinct FROM x"""
