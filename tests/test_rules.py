"""Edge tables for the rule expressions and goldens from FIXTURES.md."""

from pyspark.sql import functions as F

from cardlens.functions import rules
from cardlens.operators import recommend


def test_band_edges(spark):
    df = spark.createDataFrame([(s,) for s in [0, 1, 20, 21, 40, 41, 60, 61, 70, 71]], "s long")
    got = [r[0] for r in df.select(rules.score_band("s")).collect()]
    assert got == ["Fair", "Poor", "Poor", "Fair", "Fair", "Good", "Good", "Excellent", "Excellent", "Fair"]


def test_age_group_edges(spark):
    df = spark.createDataFrame([(a,) for a in [0, 1, 30, 31, 60, 61, 100, 101]], "a long")
    got = [r[0] for r in df.select(rules.age_group("a")).collect()]
    assert got == [None, "<30", "<30", "30-40", "50-60", "60+", "60+", None]


def test_zero_divisors(spark):
    df = spark.createDataFrame([(100, 0, 0.0)], "amt long, ct long, lim double")
    r = df.select(rules.safe_ratio(F.col("amt"), F.col("ct")).alias("a"),
                  rules.safe_ratio(F.col("amt"), F.col("lim")).alias("b")).first()
    assert (r.a, r.b) == (100.0, 100.0)


def test_credit_score_and_fraud_rules(spark):
    row = dict(Income=50001, Total_Revolving_Bal=999, Avg_Utilization_Ratio=0.29, Delinquent_Acc=0,
               House_Owner="yes", Personal_loan="no", Customer_Age=41, Cust_Satisfaction_Score=4,
               Total_Trans_Amt=10001, Total_Trans_Ct=19)
    df = spark.createDataFrame([row])
    r = df.select(rules.credit_score().alias("s"), rules.fraud_flag().alias("f")).first()
    assert (r.s, r.f) == (70, 1)
    edge = dict(row, Income=50000, Total_Revolving_Bal=1000, Avg_Utilization_Ratio=0.3, Customer_Age=40,
                Cust_Satisfaction_Score=3, Total_Trans_Amt=10000, Total_Trans_Ct=20)
    r = spark.createDataFrame([edge]).select(rules.credit_score().alias("s"), rules.fraud_flag().alias("f")).first()
    assert (r.s, r.f) == (30, 0)


def test_default_custom_profile_golden(spark):
    """FIXTURES.md §4: age 35, income 60000, score 680, balance 2000,
    amount 3000, count 40 -> Secured Builder 53.333, Cash Back Plus 30,
    Premium Rewards 0; segment standard."""
    prof = spark.createDataFrame([(1, 35, 60000, 680.0, 2000, 3000, 40)],
                                 "Profile_Id long, Customer_Age long, Income long, credit_score double, "
                                 "Total_Revolving_Bal long, Total_Trans_Amt long, Total_Trans_Ct long")
    p = recommend.with_segment(recommend.custom_profiles(prof))
    r = p.first()
    assert r.Credit_Limit == 18000.0 and abs(r.Avg_Utilization_Ratio - 0.111111) < 1e-6
    assert r.segment == "standard"
    recs = recommend.recommend_cards(p, 3, key="Profile_Id").orderBy("rec_rank").collect()
    assert [x.card_name for x in recs] == ["Secured Builder Card", "Cash Back Plus", "Premium Rewards Card"]
    assert abs(recs[0].match_score - 53.333333) < 1e-5 and recs[1].match_score == 30.0 and recs[2].match_score == 0.0


def test_missing_profile_fields_take_defaults(spark):
    df = spark.createDataFrame([(1, None)], "Client_Num long, Income long")
    r = recommend.with_segment(df).first()
    assert r.segment == "starter"
    scores = recommend.card_match_scores(df).orderBy("catalog_pos").collect()
    assert all(s.match_score == 0.0 for s in scores)  # income 0, score 650 -> every card penalised


def test_match_tiers(spark):
    df = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (10.0,)], "match_score double")
    got = [r.match_tier for r in recommend.with_match_tier(df).collect()]
    assert got == ["Excellent match", "Good match", "Good match", "Fair match"]


def test_sample_pair_goldens(spark, tmp_path):
    """Two small files in the shipped layout (BOM, CRLF, blank headers, dates as
    text), scored end to end against values worked out by hand."""
    from cardlens.operators import cleanse, explore, scoring
    from cardlens.sources import csv
    cc = ["Client_Num,Card_Category,Annual_Fees,Activation_30_Days,Customer_Acq_Cost,Week_Start_Date,Week_Num,Qtr,current_year,Credit_Limit,"
          "Total_Revolving_Bal,Total_Trans_Amt,Total_Trans_Ct,Avg_Utilization_Ratio,Use Chip,Exp Type,Interest_Earned,Delinquent_Acc",
          "1,Blue,95,1,87,31-12-2023,Week-53,Q4,2023,5000,500,1000,10,0.1,Swipe ,Bills,82,0",      # all eight rules
          "2,Blue,95,0,87,31-12-2023,Week-53,Q4,2023,0,1000,20000,19,0.95,Chip ,Food,82,1",        # none; fraud by all three
          "3,Gold,95,0,87,xx,Week-53,Q4,2023,2000,999,60001,50,0.3,Online ,Food,82,0",             # balance and no delinquency; amount > 3 x income
          "9,Gold,95,0,87,31-12-2023,Week-53,Q4,2023,2000,999,1,1,0.3,Online ,Food,82,0"]          # no customer
    cust = ["Client_Num,Customer_Age,Gender,Dependent_Count,Education_Level,Marital_Status,State_cd,Zipcode,Car_Owner,House_Owner,"
            "Personal_Loan,Contact,Customer_Job,Income,Cust_Satisfaction_Score",
            "1,41,F,1,Graduate,Single,NY,00123,no,yes,no,cellular,Govt,50001,4",
            "2,40,M,1,Graduate,Single,NY,00123,no,no,yes,cellular,Govt,6000,3",
            "3,40,M,1,Graduate,Single,NY,00123,no,no,yes,cellular,Govt,20000,3"]
    for name, lines in (("cc", cc), ("cust", cust)):
        (tmp_path / f"{name}.csv").write_bytes(("\ufeff" + "\r\n".join(lines) + "\r\n").encode())
    joined = scoring.join_profile(csv.read_cc_csv(spark, f"{tmp_path}/cc.csv"), csv.read_cust_csv(spark, f"{tmp_path}/cust.csv"))
    p = scoring.add_scores(cleanse.clean(joined))
    got = {r.Client_Num: (r.credit_score, r.credit_score_band, r.fraud_flag, r.Trans_Avg, r.Income_to_Credit_Ratio) for r in p.collect()}
    assert got == {1: (70, "Excellent", 0, 100.0, 50001 / 5000), 2: (0, "Fair", 1, 20000 / 19, 6000.0), 3: (30, "Fair", 1, 60001 / 50, 10.0)}
    assert p.where("Week_Start_Date IS NULL").first().Client_Num == 3
    stats = explore.aggregate_stats(p).first()
    assert (stats.total_customers, stats.total_transactions, stats.total_transaction_amount) == (3, 79, 81001)
    assert abs(stats.avg_credit_limit - 2333.333333) < 1e-6 and abs(stats.fraud_rate - 66.666667) < 1e-6
