"""DuckDB rendering of the adapter, cleansing and scoring, used as a CTE
prefix by every oracle query.  Written as plain SQL, independently of the
Spark code, so that the oracle is a second implementation of the rules."""

from __future__ import annotations

NUMERIC_COLS = [
    "Txn_Id", "Client_Num", "Annual_Fees", "Activation_30_Days", "Customer_Acq_Cost",
    "current_year", "Credit_Limit", "Total_Revolving_Bal", "Total_Trans_Amt", "Total_Trans_Ct",
    "Avg_Utilization_Ratio", "Interest_Earned", "Delinquent_Acc", "Customer_Age",
    "Dependent_Count", "Income", "Cust_Satisfaction_Score",
]
STRING_COLS = [
    "Card_Category", "Week_Num", "Qtr", "Use_Chip", "Exp_Type", "Gender", "Education_Level",
    "Marital_Status", "state_cd", "Zipcode", "Car_Owner", "House_Owner", "Personal_loan",
    "contact", "Customer_Job",
]

CUST = """
cust_detail AS (
  SELECT c_custkey AS Client_Num,
    18 + (c_custkey * 7) % 60 AS Customer_Age,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS Gender,
    c_custkey % 6 AS Dependent_Count,
    CASE WHEN c_custkey % 11 = 0 THEN NULL
         WHEN c_custkey % 3 = 0 THEN 'Graduate'
         WHEN c_custkey % 3 = 1 THEN 'High School' ELSE 'Doctorate' END AS Education_Level,
    CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' WHEN c_custkey % 4 = 1 THEN 'Single'
         ELSE 'Married' END AS Marital_Status,
    n_name AS state_cd,
    CAST(n_nationkey AS VARCHAR) AS Zipcode,
    CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS Car_Owner,
    CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS House_Owner,
    CASE WHEN c_custkey % 5 = 0 THEN 'yes' ELSE 'no' END AS Personal_loan,
    CASE WHEN c_custkey % 3 = 0 THEN 'cellular' WHEN c_custkey % 3 = 1 THEN 'telephone'
         ELSE 'unknown' END AS contact,
    c_mktsegment AS Customer_Job,
    CAST(floor((c_acctbal + 1000) * 15) AS BIGINT) AS Income,
    CAST(1 + c_custkey % 5 AS BIGINT) AS Cust_Satisfaction_Score
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

CC = """
li_qty AS (SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
cc_base AS (
  SELECT o.*, qty, CAST(date_trunc('week', o_orderdate) AS DATE) AS ws
  FROM orders o LEFT JOIN li_qty ON o_orderkey = l_orderkey),
cc_detail AS (
  SELECT o_orderkey AS Txn_Id, o_custkey AS Client_Num, o_orderpriority AS Card_Category,
    95 + (o_orderkey % 5) * 100 AS Annual_Fees,
    CAST(CASE WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END AS BIGINT) AS Activation_30_Days,
    41 + (o_orderkey * 11) % 132 AS Customer_Acq_Cost,
    ws AS Week_Start_Date,
    'Week-' || CAST(weekofyear(ws) AS VARCHAR) AS Week_Num,
    'Q' || CAST(quarter(ws) AS VARCHAR) AS Qtr,
    CAST(year(ws) AS BIGINT) AS current_year,
    CASE WHEN o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST(1000 + (o_orderkey * 37) % 34000 AS DOUBLE) END AS Credit_Limit,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE (o_orderkey * 13) % 2518 END AS Total_Revolving_Bal,
    CAST(floor(o_totalprice / 10) AS BIGINT) AS Total_Trans_Amt,
    CAST(COALESCE(qty, 0) AS BIGINT) AS Total_Trans_Ct,
    CAST((o_orderkey * 29) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS Avg_Utilization_Ratio,
    o_orderstatus AS Use_Chip,
    CASE o_orderkey % 6 WHEN 0 THEN 'Bills' WHEN 1 THEN 'Entertainment' WHEN 2 THEN 'Grocery'
         WHEN 3 THEN 'Fuel' WHEN 4 THEN 'Food' ELSE 'Travel' END AS Exp_Type,
    CAST((o_orderkey * 17) % 5000 AS DOUBLE) / CAST(10 AS DOUBLE) AS Interest_Earned,
    CAST(CASE WHEN o_orderkey % 18 = 0 THEN 1 ELSE 0 END AS BIGINT) AS Delinquent_Acc
  FROM cc_base)"""


def _modes() -> str:
    parts = []
    for c in STRING_COLS:
        parts.append(
            f"(SELECT {c} FROM joined WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY COUNT(*) DESC, {c} ASC LIMIT 1) AS m_{c}")
    return "modes AS (SELECT " + ",\n  ".join(parts) + ")"


def _clean() -> str:
    cols = [f"COALESCE({c}, 0) AS {c}" for c in NUMERIC_COLS]
    cols += [f"COALESCE({c}, m_{c}, 'Unknown') AS {c}" for c in STRING_COLS]
    cols.append("Week_Start_Date")
    return "clean AS (SELECT " + ",\n  ".join(cols) + " FROM joined CROSS JOIN modes)"


SCORED = """
scored AS (
  SELECT *,
    CAST((CASE WHEN Income > 50000 THEN 10 ELSE 0 END)
       + (CASE WHEN Total_Revolving_Bal < 1000 THEN 10 ELSE 0 END)
       + (CASE WHEN Avg_Utilization_Ratio < 0.3 THEN 10 ELSE 0 END)
       + (CASE WHEN Delinquent_Acc = 0 THEN 20 ELSE 0 END)
       + (CASE WHEN House_Owner = 'yes' THEN 5 ELSE 0 END)
       + (CASE WHEN Personal_loan = 'no' THEN 5 ELSE 0 END)
       + (CASE WHEN Customer_Age > 40 THEN 5 ELSE 0 END)
       + (CASE WHEN Cust_Satisfaction_Score >= 4 THEN 5 ELSE 0 END) AS BIGINT) AS credit_score,
    CAST(CASE WHEN (Total_Trans_Amt > 10000 AND Total_Trans_Ct < 20)
                OR Avg_Utilization_Ratio > 0.9
                OR Total_Trans_Amt > 3 * Income THEN 1 ELSE 0 END AS BIGINT) AS fraud_flag,
    CAST(Total_Trans_Amt AS DOUBLE)
      / CAST(CASE WHEN Total_Trans_Ct = 0 THEN 1 ELSE Total_Trans_Ct END AS DOUBLE) AS Trans_Avg,
    CAST(Income AS DOUBLE)
      / CASE WHEN Credit_Limit = 0 THEN CAST(1 AS DOUBLE) ELSE Credit_Limit END AS Income_to_Credit_Ratio,
    CAST(Total_Revolving_Bal AS DOUBLE)
      / CASE WHEN Credit_Limit = 0 THEN CAST(1 AS DOUBLE) ELSE Credit_Limit END AS Revolving_to_Credit_Ratio
  FROM clean),
portfolio AS (
  SELECT *,
    CASE WHEN credit_score > 0 AND credit_score <= 20 THEN 'Poor'
         WHEN credit_score > 20 AND credit_score <= 40 THEN 'Fair'
         WHEN credit_score > 40 AND credit_score <= 60 THEN 'Good'
         WHEN credit_score > 60 AND credit_score <= 70 THEN 'Excellent'
         ELSE 'Fair' END AS credit_score_band
  FROM scored)"""

PRELUDE = ("WITH " + CUST + ",\n" + CC + ",\n"
           + "joined AS (SELECT * FROM cc_detail JOIN cust_detail USING (Client_Num)),\n"
           + _modes() + ",\n" + _clean() + ",\n" + SCORED)


def with_prelude(body: str) -> str:
    """``body`` may define further CTEs (``name AS (...), ...``) before a
    final SELECT; pass it starting with ', name AS (' or with 'SELECT'."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return PRELUDE + "\n" + body
    return PRELUDE + body
