"""DuckDB SQL for each registered query (same column names and types)."""

from __future__ import annotations

from .oracle_prelude import with_prelude

SQL: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    SQL[name] = with_prelude(body)


def mix32(k: str, mult: int) -> str:
    a = f"({k} % 4294967296)"
    return (f"(((({a} >> 16) * {mult}) % 65536) * 65536 + ({a} & 65535) * {mult}) % 4294967296")


# ---- A ----------------------------------------------------------------------
sql("append_batches", """
SELECT Txn_Id, Client_Num, Week_Start_Date, Total_Trans_Amt, Interest_Earned, 'base' AS batch
FROM cc_detail WHERE current_year < 1999
UNION ALL
SELECT Txn_Id, Client_Num, Week_Start_Date, Total_Trans_Amt, CAST(NULL AS DOUBLE), 'additional'
FROM cc_detail WHERE current_year >= 1999
""")

sql("normalize_values", "SELECT Txn_Id, Card_Category, Use_Chip, Exp_Type FROM cc_detail")

# ---- B ----------------------------------------------------------------------
sql("parse_dates", """
SELECT Txn_Id, CAST(TRY_STRPTIME(CASE WHEN Txn_Id % 89 = 0 THEN 'n/a'
                                      ELSE strftime(Week_Start_Date, '%d-%m-%Y') END,
                                 '%d-%m-%Y') AS DATE) AS Week_Start_Date
FROM cc_detail
""")

sql("fill_numeric", """
SELECT Txn_Id, COALESCE(Total_Revolving_Bal, 0) AS Total_Revolving_Bal, Credit_Limit, Total_Trans_Ct
FROM joined
""")

sql("fill_mode", "SELECT Txn_Id, Education_Level, Marital_Status, Card_Category FROM clean")

sql("fill_default", """
SELECT COALESCE(Personal_loan, 'no') AS Personal_loan, COUNT(*) AS n_rows FROM joined GROUP BY 1
""")

# ---- C ----------------------------------------------------------------------
sql("credit_score", "SELECT Txn_Id, credit_score FROM portfolio")
sql("credit_score_band", "SELECT Txn_Id, credit_score, credit_score_band FROM portfolio")
sql("fraud_flag", "SELECT Txn_Id, fraud_flag FROM portfolio")
sql("ratio_features", """
SELECT Txn_Id, ROUND(Trans_Avg, 6) AS Trans_Avg, ROUND(Income_to_Credit_Ratio, 6) AS Income_to_Credit_Ratio,
       ROUND(Revolving_to_Credit_Ratio, 6) AS Revolving_to_Credit_Ratio
FROM portfolio
""")
sql("train_test_split", f"""
SELECT Txn_Id, CASE WHEN {mix32('Txn_Id', 2654435761)} < 3435973837 THEN 'train' ELSE 'test' END AS split
FROM portfolio
""")

# ---- D ----------------------------------------------------------------------
sql("account_profile_join", "SELECT Txn_Id, Client_Num, Customer_Age, Income, Total_Trans_Amt FROM joined")

sql("customer_profile", """
, firsts AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Client_Num ORDER BY Txn_Id) AS rn FROM portfolio)
  WHERE rn = 1)
SELECT c.Client_Num, f.Txn_Id, f.Customer_Age, f.Income, f.Credit_Limit, f.Total_Revolving_Bal,
       f.Total_Trans_Amt, f.Total_Trans_Ct, f.Avg_Utilization_Ratio, f.credit_score,
       f.credit_score_band, f.fraud_flag,
       CAST(CASE WHEN f.Txn_Id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found
FROM cust_detail c LEFT JOIN firsts f ON c.Client_Num = f.Client_Num
""")

sql("customers_missing", """
SELECT Client_Num, CASE WHEN EXISTS (SELECT 1 FROM portfolio p WHERE p.Client_Num = c.Client_Num
                                      AND p.fraud_flag = 1) THEN 'found' ELSE 'missing' END AS status
FROM cust_detail c
""")

sql("recent_transactions", """
SELECT * FROM (
  SELECT Client_Num, Txn_Id, Week_Start_Date, Total_Trans_Amt, Total_Trans_Ct, Exp_Type,
         ROW_NUMBER() OVER (PARTITION BY Client_Num ORDER BY Week_Start_Date DESC NULLS LAST, Txn_Id ASC)
           AS recent_rank
  FROM portfolio)
WHERE recent_rank <= 10
""")

sql("aggregate_stats", """
SELECT COUNT(DISTINCT Client_Num) AS total_customers,
       CAST(SUM(Total_Trans_Ct) AS BIGINT) AS total_transactions,
       CAST(SUM(Total_Trans_Amt) AS BIGINT) AS total_transaction_amount,
       ROUND(AVG(Credit_Limit), 6) AS avg_credit_limit,
       ROUND(AVG(Avg_Utilization_Ratio), 6) AS avg_utilization,
       ROUND(AVG(fraud_flag) * 100, 6) AS fraud_rate
FROM portfolio
""")

sql("band_distribution", """
, dom(credit_score_band, band_order) AS (
  VALUES ('Poor', 1), ('Fair', 2), ('Good', 3), ('Excellent', 4))
SELECT d.credit_score_band, CAST(d.band_order AS BIGINT) AS band_order,
       CAST(COUNT(p.Txn_Id) AS BIGINT) AS n_rows
FROM dom d LEFT JOIN portfolio p ON p.credit_score_band = d.credit_score_band
GROUP BY d.credit_score_band, d.band_order
""")

sql("fraud_distribution", """
SELECT fraud_flag, CASE fraud_flag WHEN 0 THEN 'Legitimate' WHEN 1 THEN 'Fraudulent' END AS fraud_label,
       COUNT(*) AS n_rows
FROM portfolio GROUP BY fraud_flag
""")

sql("overview_metrics", """
SELECT COUNT(*) AS n_records, COUNT(DISTINCT Client_Num) AS n_customers,
       ROUND(AVG(Credit_Limit), 6) AS avg_credit_limit,
       ROUND(AVG(Total_Revolving_Bal), 6) AS avg_revolving_bal,
       ROUND(AVG(Total_Trans_Amt), 6) AS avg_trans_amt,
       ROUND(AVG(Total_Trans_Ct), 6) AS avg_trans_ct,
       ROUND(AVG(Avg_Utilization_Ratio), 6) AS avg_utilization,
       ROUND(AVG(fraud_flag), 6) AS fraud_rate
FROM portfolio
""")

sql("preview", """
SELECT Txn_Id, Client_Num, Card_Category, Week_Start_Date, Credit_Limit, Total_Trans_Amt,
       credit_score, credit_score_band, fraud_flag
FROM portfolio ORDER BY Txn_Id LIMIT 5
""")

SEARCH_AGG = """
SELECT COUNT(*) AS n_records, ROUND(AVG(Customer_Age), 6) AS avg_age, ROUND(AVG(Income), 6) AS avg_income,
       ROUND(AVG(Credit_Limit), 6) AS avg_credit_limit, ROUND(AVG(Total_Revolving_Bal), 6) AS avg_revolving_bal,
       ROUND(AVG(fraud_flag), 6) AS fraud_rate, ROUND(AVG(Cust_Satisfaction_Score), 6) AS avg_satisfaction
FROM portfolio
"""

sql("customer_search", """
SELECT Txn_Id, Client_Num, Customer_Age, Gender, Income, Credit_Limit, credit_score_band, fraud_flag
FROM portfolio WHERE Customer_Age BETWEEN 30 AND 60 AND Income BETWEEN 20000 AND 100000
""")
sql("search_aggregates", SEARCH_AGG + " WHERE Customer_Age BETWEEN 30 AND 60 AND Income BETWEEN 20000 AND 100000")
sql("customer_search_filtered", SEARCH_AGG + """ WHERE Customer_Age BETWEEN 25 AND 50
  AND Income BETWEEN 30000 AND 120000 AND Gender = 'F' AND credit_score_band = 'Good'""")

sql("weekly_trends", """
SELECT Week_Start_Date, ROUND(AVG(Total_Trans_Amt), 6) AS avg_trans_amt,
       ROUND(AVG(Total_Trans_Ct), 6) AS avg_trans_ct, ROUND(AVG(fraud_flag) * 100, 6) AS fraud_percentage
FROM portfolio WHERE Week_Start_Date IS NOT NULL GROUP BY Week_Start_Date
""")

AGE_GROUP = """CASE WHEN Customer_Age > 0 AND Customer_Age <= 30 THEN '<30'
     WHEN Customer_Age > 30 AND Customer_Age <= 40 THEN '30-40'
     WHEN Customer_Age > 40 AND Customer_Age <= 50 THEN '40-50'
     WHEN Customer_Age > 50 AND Customer_Age <= 60 THEN '50-60'
     WHEN Customer_Age > 60 AND Customer_Age <= 100 THEN '60+' END"""

sql("age_groups", f"SELECT Txn_Id, Customer_Age, {AGE_GROUP} AS Age_Group FROM portfolio")

sql("age_band_counts", f"""
, ages(Age_Group, age_order) AS (VALUES ('<30', 1), ('30-40', 2), ('40-50', 3), ('50-60', 4), ('60+', 5)),
bands(credit_score_band, band_order) AS (VALUES ('Poor', 1), ('Fair', 2), ('Good', 3), ('Excellent', 4)),
counts AS (SELECT {AGE_GROUP} AS Age_Group, credit_score_band, COUNT(*) AS n FROM portfolio GROUP BY 1, 2)
SELECT a.Age_Group, CAST(a.age_order AS BIGINT) AS age_order, b.credit_score_band,
       CAST(b.band_order AS BIGINT) AS band_order, CAST(COALESCE(c.n, 0) AS BIGINT) AS n_rows
FROM ages a CROSS JOIN bands b
LEFT JOIN counts c ON c.Age_Group = a.Age_Group AND c.credit_score_band = b.credit_score_band
""")

SAMPLE = f"""
, sampled AS (
  SELECT *, {mix32('Txn_Id', 2246822519)} AS sample_hash FROM portfolio
  ORDER BY sample_hash, Txn_Id LIMIT 1000)
"""
sql("bounded_sample", SAMPLE + "SELECT Txn_Id, Client_Num, sample_hash FROM sampled")
sql("income_limit_points", SAMPLE + "SELECT Txn_Id, Income, Credit_Limit, credit_score_band FROM sampled")

# ---- F ----------------------------------------------------------------------
CATALOG = """
, catalog(catalog_pos, card_name, annual_fee, rewards_rate, points_multiplier, min_credit_score, min_income) AS (
  VALUES (1, 'Premium Rewards Card', 95, CAST(0.02 AS DOUBLE), 3, 720, 60000),
         (2, 'Cash Back Plus', 0, CAST(0.015 AS DOUBLE), 2, 680, 40000),
         (3, 'Secured Builder Card', 0, CAST(0.01 AS DOUBLE), 1, 580, 25000),
         (4, 'Balance Transfer Elite', 0, CAST(0.01 AS DOUBLE), 1, 690, 45000),
         (5, 'Business Rewards Card', 125, CAST(0.018 AS DOUBLE), 3, 700, 75000)),
firsts AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Client_Num ORDER BY Txn_Id) AS rn FROM portfolio)
  WHERE rn = 1)
"""


def match_expr(inc="inc", sc="sc", util="util", ct="ct", amt="amt") -> str:
    return f"""LEAST(CAST(100 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE),
    CASE WHEN {sc} < min_credit_score OR {inc} < min_income THEN CAST(-50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CAST(20 AS DOUBLE) * LEAST({inc} / CAST(min_income AS DOUBLE), CAST(2 AS DOUBLE))
    + CAST(20 AS DOUBLE) * GREATEST(CAST(0 AS DOUBLE),
        LEAST(({sc} - CAST(min_credit_score AS DOUBLE)) / CAST(150 AS DOUBLE), CAST(1 AS DOUBLE)))
    + CASE WHEN {util} > 0.5 AND card_name LIKE '%Balance Transfer%' THEN CAST(30 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN {ct} > 50 AND rewards_rate > CAST(0.015 AS DOUBLE) THEN CAST(25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + CASE WHEN {amt} > 5000 AND points_multiplier > 1 THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    - CASE WHEN annual_fee > 0 THEN LEAST(CAST(20 AS DOUBLE), CAST(annual_fee AS DOUBLE) / CAST(10 AS DOUBLE))
           ELSE CAST(0 AS DOUBLE) END))"""


PROFILE_SCORES = CATALOG + f""",
prof AS (
  SELECT Client_Num, CAST(Income AS DOUBLE) AS inc, CAST(credit_score AS DOUBLE) AS sc,
         Avg_Utilization_Ratio AS util, CAST(Total_Trans_Ct AS DOUBLE) AS ct,
         CAST(Total_Trans_Amt AS DOUBLE) AS amt FROM firsts),
scores AS (
  SELECT Client_Num, CAST(catalog_pos AS BIGINT) AS catalog_pos, card_name, annual_fee,
         CAST(CASE WHEN sc >= min_credit_score AND inc >= min_income THEN 1 ELSE 0 END AS BIGINT) AS eligible,
         {match_expr()} AS match_score
  FROM prof CROSS JOIN catalog),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY Client_Num ORDER BY ROUND(match_score, 9) DESC, catalog_pos)
    AS rec_rank FROM scores)
"""

SEGMENT = """CASE WHEN {inc} >= 75000 AND {sc} >= 720 THEN 'premium'
     WHEN {inc} >= 45000 AND {sc} >= 680 THEN 'standard' ELSE 'starter' END"""

TIER = """CASE WHEN match_score >= 80 THEN 'Excellent match' WHEN match_score >= 60 THEN 'Good match'
     ELSE 'Fair match' END"""

sql("user_segment", CATALOG + f"""
SELECT Client_Num, Income, credit_score, {SEGMENT.format(inc='Income', sc='credit_score')} AS segment FROM firsts
""")
sql("card_eligibility", PROFILE_SCORES + "SELECT Client_Num, catalog_pos, card_name, eligible FROM scores")
sql("card_match_scores", PROFILE_SCORES +
    "SELECT Client_Num, catalog_pos, card_name, ROUND(match_score, 6) AS match_score FROM scores")
sql("recommend_cards", PROFILE_SCORES + """
SELECT Client_Num, CAST(rec_rank AS BIGINT) AS rec_rank, card_name, ROUND(match_score, 6) AS match_score,
       CAST(annual_fee AS BIGINT) AS annual_fee
FROM ranked WHERE rec_rank <= 3
""")
sql("match_tiers", PROFILE_SCORES + f"""
SELECT Client_Num, CAST(rec_rank AS BIGINT) AS rec_rank, {TIER} AS match_tier FROM ranked WHERE rec_rank <= 3
""")

BUREAU = "CAST(300 AS DOUBLE) + CAST(credit_score AS DOUBLE) * CAST(550 AS DOUBLE) / CAST(70 AS DOUBLE)"
sql("user_segment_bureau", CATALOG + f"""
, bureau AS (SELECT Client_Num, Income, {BUREAU} AS sc FROM firsts)
SELECT Client_Num, Income, ROUND(sc, 6) AS credit_score, {SEGMENT.format(inc='Income', sc='sc')} AS segment FROM bureau
""")
sql("card_match_scores_bureau", PROFILE_SCORES.replace("CAST(credit_score AS DOUBLE) AS sc", f"{BUREAU} AS sc") +
    "SELECT Client_Num, catalog_pos, card_name, eligible, ROUND(match_score, 6) AS match_score FROM scores")

APPLICANTS = """
, app0 AS (
  SELECT Txn_Id AS Profile_Id, CAST(Income AS DOUBLE) AS inc,
         CAST(300 AS DOUBLE) + CAST(credit_score AS DOUBLE) * CAST(550 AS DOUBLE) / CAST(70 AS DOUBLE) AS sc,
         Total_Revolving_Bal, CAST(Total_Trans_Amt AS DOUBLE) AS amt, CAST(Total_Trans_Ct AS DOUBLE) AS ct,
         LEAST(CAST(Income AS DOUBLE) * CAST(0.3 AS DOUBLE), CAST(30000 AS DOUBLE)) AS lim
  FROM portfolio),
app AS (
  SELECT *, CASE WHEN lim > 0 THEN CAST(Total_Revolving_Bal AS DOUBLE) / lim ELSE CAST(0 AS DOUBLE) END AS util
  FROM app0)
"""
sql("custom_profiles", APPLICANTS + """
SELECT Profile_Id, ROUND(lim, 6) AS Credit_Limit, ROUND(util, 6) AS Avg_Utilization_Ratio FROM app
""")
sql("custom_recommendations", APPLICANTS + CATALOG + f""",
sc2 AS (
  SELECT Profile_Id, {SEGMENT.format(inc='inc', sc='sc')} AS segment, catalog_pos, card_name,
         {match_expr()} AS match_score
  FROM app CROSS JOIN catalog),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Profile_Id ORDER BY ROUND(match_score, 9) DESC, catalog_pos)
         AS rec_rank FROM sc2)
SELECT Profile_Id, segment, CAST(rec_rank AS BIGINT) AS rec_rank, card_name,
       ROUND(match_score, 6) AS match_score, {TIER} AS match_tier
FROM rk WHERE rec_rank <= 3
""")

# ---- C7/C10/E: features and metrics ------------------------------------------
# Category levels of the adapter's columns (sorted; the first is dropped).
LEVELS = {
    "Card_Category": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "Use_Chip": ["F", "O", "P"],
    "Exp_Type": ["Bills", "Entertainment", "Food", "Fuel", "Grocery", "Travel"],
    "Gender": ["F", "M"],
    "Education_Level": ["Doctorate", "Graduate", "High School"],
    "Marital_Status": ["Married", "Single", "Unknown"],
    "Customer_Job": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}
sql("one_hot", "SELECT Txn_Id, " + ", ".join(
    f"CAST(CASE WHEN {c} = '{lev}' THEN 1 ELSE 0 END AS BIGINT) AS \"{c}_{lev}\""
    for c, levs in LEVELS.items() for lev in levs[1:]) + " FROM portfolio")

NUMF = ["Customer_Age", "Dependent_Count", "Income", "Credit_Limit", "Total_Revolving_Bal",
        "Total_Trans_Amt", "Total_Trans_Ct", "Avg_Utilization_Ratio", "Trans_Avg",
        "Income_to_Credit_Ratio", "Revolving_to_Credit_Ratio"]
sql("standardize", ", st AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in NUMF) + " FROM portfolio)\nSELECT Txn_Id, " + ", ".join(
    f"ROUND((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in NUMF)
    + " FROM portfolio CROSS JOIN st")

SPLIT = f"CASE WHEN {mix32('Txn_Id', 2654435761)} < 3435973837 THEN 'train' ELSE 'test' END"

sql("class_weights", f"""
, tr AS (SELECT * FROM portfolio WHERE {SPLIT} = 'train'),
c AS (SELECT fraud_flag AS label, COUNT(*) AS n_rows FROM tr GROUP BY 1),
t AS (SELECT SUM(n_rows) AS tot, COUNT(*) AS k,
             SUM(CASE WHEN label = 0 THEN n_rows ELSE 0 END) AS n0,
             SUM(CASE WHEN label = 1 THEN n_rows ELSE 0 END) AS n1 FROM c)
SELECT label, n_rows, ROUND(CAST(tot AS DOUBLE) / (CAST(k AS DOUBLE) * CAST(n_rows AS DOUBLE)), 6) AS class_weight,
       ROUND(CAST(n0 AS DOUBLE) / CAST(n1 AS DOUBLE), 6) AS scale_pos_weight
FROM c CROSS JOIN t
""")

BAND_PRED = f"""
, te AS (SELECT * FROM portfolio WHERE {SPLIT} = 'test'),
bw AS (SELECT *, credit_score + (Txn_Id * 7) % 11 - 5 AS s2 FROM te),
bw2 AS (SELECT *, 100 - ABS(s2 - 10) AS w1, 100 - ABS(s2 - 30) AS w2, 100 - ABS(s2 - 50) AS w3,
               100 - ABS(s2 - 65) AS w4 FROM bw),
bp AS (SELECT *, CAST(w1 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p1,
                 CAST(w2 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p2,
                 CAST(w3 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p3,
                 CAST(w4 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p4 FROM bw2),
bpred AS (SELECT *, GREATEST(p1, p2, p3, p4) AS probability,
       CASE WHEN p1 = GREATEST(p1, p2, p3, p4) THEN 'Poor' WHEN p2 = GREATEST(p1, p2, p3, p4) THEN 'Fair'
            WHEN p3 = GREATEST(p1, p2, p3, p4) THEN 'Good' ELSE 'Excellent' END AS credit_score_band_pred
  FROM bp),
fs AS (SELECT *, (Avg_Utilization_Ratio + CAST((Txn_Id * 13) % 100 AS DOUBLE) / CAST(100 AS DOUBLE))
                 / CAST(2 AS DOUBLE) AS fraud_probability FROM te),
fpred AS (SELECT *, CAST(CASE WHEN fraud_probability > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS fraud_prediction,
       CASE WHEN fraud_probability > 0.7 THEN 'High' WHEN fraud_probability > 0.3 THEN 'Medium' ELSE 'Low' END
         AS risk_level FROM fs),
preds AS (
  SELECT 'credit' AS task, credit_score_band AS actual, credit_score_band_pred AS predicted FROM bpred
  UNION ALL
  SELECT 'fraud', CAST(fraud_flag AS VARCHAR), CAST(fraud_prediction AS VARCHAR) FROM fpred),
pc AS (SELECT task, actual, predicted, COUNT(*) AS n FROM preds GROUP BY ALL),
labels AS (SELECT DISTINCT task, actual AS class FROM pc UNION SELECT DISTINCT task, predicted FROM pc),
cls AS (
  SELECT l.task, l.class,
    COALESCE((SELECT SUM(n) FROM pc WHERE pc.task = l.task AND pc.actual = l.class), 0) AS support,
    COALESCE((SELECT SUM(n) FROM pc WHERE pc.task = l.task AND pc.actual = l.class AND pc.predicted = l.class), 0) AS tp,
    COALESCE((SELECT SUM(n) FROM pc WHERE pc.task = l.task AND pc.predicted = l.class), 0) AS n_pred
  FROM labels l),
per AS (
  SELECT task, class,
    CASE WHEN n_pred = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(n_pred AS DOUBLE) END AS precision,
    CASE WHEN support = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) END AS recall,
    CAST(support AS BIGINT) AS support
  FROM cls),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN CAST(0 AS DOUBLE)
                        ELSE precision * recall * 2 / (precision + recall) END AS f1 FROM per),
report AS (
  SELECT task, class, precision, recall, f1, support FROM per2
  UNION ALL
  SELECT task, 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM per2 GROUP BY task
  UNION ALL
  SELECT task, 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
         SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM per2 GROUP BY task),
sc AS (SELECT fraud_probability AS score, CAST(SUM(CASE WHEN fraud_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(SUM(CASE WHEN fraud_flag = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
       FROM fs GROUP BY 1),
cum AS (SELECT *, SUM(pos) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_pos,
                  SUM(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg,
                  ROW_NUMBER() OVER (ORDER BY score) AS point,
                  SUM(pos) OVER () AS P, SUM(neg) OVER () AS N, COUNT(*) OVER () AS M FROM sc)
"""

sql("band_argmax", BAND_PRED + "SELECT Txn_Id, credit_score_band_pred, ROUND(probability, 6) AS probability FROM bpred")
sql("probability_rows", BAND_PRED + """
SELECT Txn_Id, class, ROUND(probability, 6) AS probability FROM (
  SELECT Txn_Id, 'Poor' AS class, p1 AS probability FROM bp UNION ALL
  SELECT Txn_Id, 'Fair', p2 FROM bp UNION ALL SELECT Txn_Id, 'Good', p3 FROM bp UNION ALL
  SELECT Txn_Id, 'Excellent', p4 FROM bp)
""")
sql("risk_levels", BAND_PRED + """
SELECT Txn_Id, ROUND(fraud_probability, 6) AS fraud_probability, fraud_prediction, risk_level FROM fpred
""")
sql("accuracy", BAND_PRED + """
SELECT task, ROUND(AVG(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds GROUP BY task
""")
sql("classification_report", BAND_PRED + """
SELECT task, class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, support
FROM report
""")
sql("confusion_matrix", BAND_PRED + """
, lab AS (SELECT task, class, CAST(ROW_NUMBER() OVER (PARTITION BY task ORDER BY class) - 1 AS BIGINT) AS idx
          FROM labels)
SELECT a.task, a.class AS actual, b.class AS predicted, a.idx AS actual_idx, b.idx AS predicted_idx,
       CAST(COALESCE(pc.n, 0) AS BIGINT) AS n
FROM lab a JOIN lab b ON a.task = b.task
LEFT JOIN pc ON pc.task = a.task AND pc.actual = a.class AND pc.predicted = b.class
""")
sql("avg_f1", BAND_PRED + "SELECT task, ROUND(AVG(f1), 6) AS avg_f1 FROM report GROUP BY task")
sql("report_long", BAND_PRED + """
SELECT task, class, metric, ROUND(value, 6) AS value FROM (
  SELECT task, class, 'precision' AS metric, precision AS value FROM report UNION ALL
  SELECT task, class, 'recall', recall FROM report UNION ALL
  SELECT task, class, 'f1', f1 FROM report UNION ALL
  SELECT task, class, 'support', CAST(support AS DOUBLE) FROM report)
""")
sql("fraud_precision", BAND_PRED + "SELECT ROUND(precision, 6) AS precision FROM report WHERE task = 'fraud' AND class = '1'")
sql("roc_auc", BAND_PRED + """
SELECT ROUND(SUM(pos * (cum_neg - neg + neg * 0.5)) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)), 6)
  AS roc_auc FROM cum
""")
sql("pr_curve", BAND_PRED + """
SELECT CAST(point AS BIGINT) AS point, ROUND(score, 6) AS threshold,
       ROUND(CAST(P - cum_pos + pos AS DOUBLE) / CAST(P - cum_pos + pos + N - cum_neg + neg AS DOUBLE), 6) AS precision,
       ROUND(CAST(P - cum_pos + pos AS DOUBLE) / CAST(P AS DOUBLE), 6) AS recall
FROM cum
UNION ALL
SELECT CAST(MAX(M) + 1 AS BIGINT), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM cum
""")
sql("score_requests", CATALOG + """
, bw AS (SELECT *, credit_score + (Txn_Id * 7) % 11 - 5 AS s2 FROM firsts),
bw2 AS (SELECT *, 100 - ABS(s2 - 10) AS w1, 100 - ABS(s2 - 30) AS w2, 100 - ABS(s2 - 50) AS w3,
               100 - ABS(s2 - 65) AS w4 FROM bw),
bp AS (SELECT *, CAST(w1 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p1,
                 CAST(w2 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p2,
                 CAST(w3 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p3,
                 CAST(w4 AS DOUBLE) / CAST(w1 + w2 + w3 + w4 AS DOUBLE) AS p4 FROM bw2),
bpred AS (SELECT *, GREATEST(p1, p2, p3, p4) AS probability,
       CASE WHEN p1 = GREATEST(p1, p2, p3, p4) THEN 'Poor' WHEN p2 = GREATEST(p1, p2, p3, p4) THEN 'Fair'
            WHEN p3 = GREATEST(p1, p2, p3, p4) THEN 'Good' ELSE 'Excellent' END AS credit_score_band_pred
  FROM bp)
SELECT c.Client_Num, CASE WHEN b.Client_Num IS NULL THEN 'Customer not found' END AS error,
       COALESCE(b.credit_score_band_pred, 'Unknown') AS credit_score_band,
       ROUND(COALESCE(b.probability, 0), 6) AS probability,
       'rule' AS model_type, CAST(CASE WHEN b.Client_Num IS NULL THEN 0 ELSE 4 END AS BIGINT) AS n_classes
FROM cust_detail c LEFT JOIN bpred b ON c.Client_Num = b.Client_Num
""")

# ---- F6-F9: similarity ---------------------------------------------------------
RECF = ["Customer_Age", "Income", "Credit_Limit", "Total_Revolving_Bal", "Total_Trans_Amt", "Total_Trans_Ct",
        "Avg_Utilization_Ratio"]
_Z = ", ".join(f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS z_{c}" for c in RECF)
_DOT = " + ".join(f"p.z_{c} * c.z_{c}" for c in RECF)
_NRM = "sqrt(" + " + ".join(f"z_{c} * z_{c}" for c in RECF) + ")"
SIMILAR = f"""
, rst AS (SELECT {", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in RECF)} FROM portfolio),
z AS (SELECT Txn_Id, Client_Num, {_Z} FROM portfolio CROSS JOIN rst),
zn AS (SELECT *, {_NRM} AS nrm FROM z),
pz AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY Client_Num ORDER BY Txn_Id) AS rn FROM zn)
       WHERE rn = 1),
pairs AS (SELECT p.Client_Num AS probe, c.Txn_Id AS neighbor_txn, c.Client_Num AS neighbor_client,
                 CASE WHEN p.nrm = 0 OR c.nrm = 0 THEN CAST(0 AS DOUBLE) ELSE ({_DOT}) / (p.nrm * c.nrm) END AS sim
          FROM pz p CROSS JOIN zn c),
simrk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY probe ORDER BY ROUND(sim, 9) DESC, neighbor_txn DESC) AS sim_rank
          FROM pairs)
"""
sql("recommender_scaler", ", rst AS (SELECT " + ", ".join(
    f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in RECF) + " FROM portfolio)\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(m_{c}, 6) AS mean, ROUND(s_{c}, 6) AS std FROM rst" for c in RECF))
sql("probe_imputation", ", rst AS (SELECT " + ", ".join(f"AVG({c}) AS m_{c}" for c in RECF) +
    " FROM portfolio)\nSELECT Client_Num, ROUND(CAST(Customer_Age AS DOUBLE), 6) AS Customer_Age, "
    "ROUND(CAST(Income AS DOUBLE), 6) AS Income, " +
    ", ".join(f"ROUND(m_{c}, 6) AS {c}" for c in RECF[2:]) + " FROM cust_detail CROSS JOIN rst")
sql("similar_customers", SIMILAR + """
SELECT probe AS Client_Num, CAST(sim_rank AS BIGINT) AS sim_rank, neighbor_txn, neighbor_client,
       ROUND(sim, 6) AS similarity FROM simrk WHERE sim_rank <= 5
""")
sql("approximate_search", """
SELECT 'customers' AS searched, (SELECT COUNT(DISTINCT Client_Num) FROM portfolio) AS n_probes, TRUE AS recall_ok, TRUE AS scores_ok
UNION ALL
SELECT 'vectors' AS searched, (SELECT COUNT(DISTINCT vec_id) FROM embeddings WHERE embedding IS NOT NULL) AS n_probes,
       TRUE AS recall_ok, TRUE AS scores_ok
""")
SQL["appended_overview"], SQL["appended_weekly_trends"] = SQL["overview_metrics"], SQL["weekly_trends"]
SQL["clustered_search_filtered"] = SQL["customer_search_filtered"]
SQL["recommender_requests"] = SQL["similar_customers"]
SQL["similar_vectors"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
en AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nrm FROM e),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id,
                 CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN CAST(0 AS DOUBLE)
                      ELSE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END AS sim
          FROM en a CROSS JOIN en b),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY ROUND(sim, 9) DESC, neighbor_id DESC) AS sim_rank
       FROM pairs)
SELECT vec_id, CAST(sim_rank AS BIGINT) AS sim_rank, neighbor_id, ROUND(sim, 6) AS similarity
FROM rk WHERE sim_rank <= 5
"""
sql("recommendation_bundle", PROFILE_SCORES.rstrip() + SIMILAR.replace("\n, rst AS", ",\nrst AS", 1) + f"""
, cards AS (SELECT Client_Num, string_agg(card_name, '|' ORDER BY rec_rank) AS cards FROM ranked
            WHERE rec_rank <= 3 GROUP BY Client_Num),
sims AS (SELECT probe AS Client_Num, string_agg(CAST(neighbor_client AS VARCHAR), ',' ORDER BY sim_rank)
           AS similar_clients FROM simrk WHERE sim_rank <= 5 GROUP BY probe)
SELECT f.Client_Num, {SEGMENT.format(inc='f.Income', sc='f.credit_score')} AS segment, cards.cards,
       sims.similar_clients
FROM firsts f JOIN cards ON cards.Client_Num = f.Client_Num LEFT JOIN sims ON sims.Client_Num = f.Client_Num
""")

# ---- C11: SMOTE ------------------------------------------------------------------
DUMMIES = [(c, lev) for c, levs in LEVELS.items() for lev in levs[1:]]
SMF = NUMF + [f"{c}_{lev}" for c, lev in DUMMIES]
_dummy_exprs = ", ".join(f"CAST(CASE WHEN {c} = '{lev}' THEN 1 ELSE 0 END AS BIGINT) AS \"{c}_{lev}\""
                         for c, lev in DUMMIES)
SMOTE_BASE = f"""
, oh AS (SELECT Txn_Id, fraud_flag, {", ".join(NUMF)}, {_dummy_exprs} FROM portfolio),
sst AS (SELECT {", ".join(f'AVG("{c}") AS "m_{c}", STDDEV_POP("{c}") AS "s_{c}"' for c in SMF)} FROM oh),
feats AS (SELECT Txn_Id, fraud_flag, {", ".join(
    f'(CAST("{c}" AS DOUBLE) - "m_{c}") / CASE WHEN "s_{c}" = 0 THEN 1 ELSE "s_{c}" END AS "{c}"' for c in SMF)}
  FROM oh CROSS JOIN sst),
mino AS (SELECT *, ROW_NUMBER() OVER (ORDER BY Txn_Id) - 1 AS j FROM feats WHERE fraud_flag = 1),
cnt AS (SELECT (SELECT COUNT(*) FROM feats WHERE fraud_flag = 0) AS n0, (SELECT COUNT(*) FROM mino) AS m),
mpairs AS (SELECT a.Txn_Id AS pk, b.Txn_Id AS ck,
                  {" + ".join(f'(a."{c}" - b."{c}") * (a."{c}" - b."{c}")' for c in SMF)} AS d
           FROM mino a JOIN mino b ON a.Txn_Id <> b.Txn_Id),
nn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pk ORDER BY ROUND(d, 9), ck) AS r FROM mpairs)
       WHERE r <= 5)
"""
sql("smote_neighbors", SMOTE_BASE + "SELECT pk AS Txn_Id, CAST(r AS BIGINT) AS nn_rank, ck AS neighbor_txn FROM nn")
sql("smote_counts", SMOTE_BASE + """
SELECT fraud_flag, CAST(COUNT(*) AS BIGINT) + CASE WHEN fraud_flag = 1 THEN (SELECT n0 - m FROM cnt) ELSE 0 END
  AS n_rows FROM feats GROUP BY fraud_flag
""")
sql("smote_rows", SMOTE_BASE + f"""
, syn AS (SELECT i, CAST(((i * 7919 + 13) % 1000) AS DOUBLE) / CAST(1000 AS DOUBLE) AS lam
          FROM cnt, range(0, n0 - m) t(i))
SELECT CAST(syn.i AS BIGINT) AS synth_index, CAST(1 AS BIGINT) AS fraud_flag,
       {", ".join(f'ROUND(x."{c}" + lam * (b."{c}" - x."{c}"), 6) + CAST(0 AS DOUBLE) AS "{c}"' for c in SMF)}
FROM syn CROSS JOIN cnt
JOIN mino x ON x.j = syn.i % cnt.m
JOIN nn ON nn.pk = x.Txn_Id AND nn.r = 1 + (syn.i // cnt.m) % 5
JOIN mino b ON b.Txn_Id = nn.ck
""")

sql("fraud_requests", CATALOG + """
, fs AS (SELECT *, (Avg_Utilization_Ratio + CAST((Txn_Id * 13) % 100 AS DOUBLE) / CAST(100 AS DOUBLE))
                   / CAST(2 AS DOUBLE) AS p FROM firsts)
SELECT c.Client_Num, CASE WHEN f.p IS NULL THEN 'Customer not found' END AS error,
       CAST(CASE WHEN f.p IS NULL THEN 0 WHEN f.p > 0.5 THEN 1 ELSE 0 END AS BIGINT) AS fraud_flag,
       ROUND(COALESCE(f.p, 0), 6) AS fraud_probability,
       CASE WHEN f.p IS NULL THEN 'Unknown' WHEN f.p > 0.7 THEN 'High' WHEN f.p > 0.3 THEN 'Medium' ELSE 'Low' END
         AS risk_level, 'rule' AS model_type
FROM cust_detail c LEFT JOIN fs f ON c.Client_Num = f.Client_Num
""")

# ---- E2-E9, E16, E17: what is determined of trained models -------------------
HELD = f"{mix32('Txn_Id', 2654435761)} >= 3435973837"
sql("credit_contract", f"""
SELECT Txn_Id, credit_score_band, TRUE AS in_domain, TRUE AS sums_to_one, TRUE AS is_argmax, 'rf' AS model_type
FROM portfolio WHERE {HELD}
""")
sql("softmax_contract", f"""
SELECT Txn_Id, credit_score_band, TRUE AS in_domain, TRUE AS sums_to_one, TRUE AS is_argmax, 'softmax' AS model_type,
       TRUE AS loss_falls, TRUE AS learned
FROM portfolio WHERE {HELD}
""")
sql("fraud_contract", f"""
SELECT Txn_Id AS row_key, fraud_flag, TRUE AS in_range, TRUE AS flag_follows, TRUE AS risk_follows, 'rf' AS model_type
FROM portfolio WHERE {HELD}
""")
sql("boosted_contract", f"""
SELECT task, Txn_Id AS key, TRUE AS lawful FROM portfolio CROSS JOIN (VALUES ('credit'), ('fraud')) t(task) WHERE {HELD}
""")
sql("evaluation_contract", f"""
, held AS (SELECT * FROM portfolio WHERE {HELD}),
kinds(kind) AS (VALUES ('rf'), ('gbt')),
tasks(task) AS (VALUES ('credit'), ('fraud')),
measures(measure) AS (VALUES ('accuracy'), ('report'), ('confusion'))
SELECT task, kind, measure, (SELECT COUNT(*) FROM held) AS n, TRUE AS lawful FROM tasks CROSS JOIN kinds CROSS JOIN measures
UNION ALL SELECT task, kind, 'importance', CAST({len(SMF)} AS BIGINT), TRUE FROM tasks CROSS JOIN kinds
UNION ALL SELECT 'fraud', kind, m, CAST(1 AS BIGINT), TRUE FROM kinds CROSS JOIN (VALUES ('roc_auc'), ('pr_curve')) t(m)
""")
sql("importance_contract", ", features(feature) AS (VALUES " + ", ".join(f"('{c}')" for c in SMF) + """)
SELECT task, feature, TRUE AS sums_to_one, TRUE AS top_is_largest FROM features CROSS JOIN (VALUES ('credit'), ('fraud')) t(task)
""")
sql("request_answers", CATALOG + """
SELECT c.Client_Num, CASE WHEN f.Client_Num IS NULL THEN 'Customer not found' END AS error, 'rf' AS model_type,
       f.Client_Num IS NOT NULL AS has_probabilities, f.Client_Num IS NOT NULL AS has_band
FROM cust_detail c LEFT JOIN firsts f ON c.Client_Num = f.Client_Num
""")
