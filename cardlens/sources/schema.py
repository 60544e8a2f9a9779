"""Declared schemas of the two base tables and the header normalisation."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, S, DT = T.LongType(), T.DoubleType(), T.StringType(), T.DateType()

# Account-week facts, in the order of the declared table.
CC_SCHEMA = T.StructType([
    T.StructField("Client_Num", L), T.StructField("Card_Category", S),
    T.StructField("Annual_Fees", L), T.StructField("Activation_30_Days", L),
    T.StructField("Customer_Acq_Cost", L), T.StructField("Week_Start_Date", DT),
    T.StructField("Week_Num", S), T.StructField("Qtr", S),
    T.StructField("current_year", L), T.StructField("Credit_Limit", D),
    T.StructField("Total_Revolving_Bal", L), T.StructField("Total_Trans_Amt", L),
    T.StructField("Total_Trans_Ct", L), T.StructField("Avg_Utilization_Ratio", D),
    T.StructField("Use_Chip", S), T.StructField("Exp_Type", S),
    T.StructField("Interest_Earned", D), T.StructField("Delinquent_Acc", L),
])

# Customer dimension.
CUST_SCHEMA = T.StructType([
    T.StructField("Client_Num", L), T.StructField("Customer_Age", L),
    T.StructField("Gender", S), T.StructField("Dependent_Count", L),
    T.StructField("Education_Level", S), T.StructField("Marital_Status", S),
    T.StructField("state_cd", S), T.StructField("Zipcode", S),
    T.StructField("Car_Owner", S), T.StructField("House_Owner", S),
    T.StructField("Personal_loan", S), T.StructField("contact", S),
    T.StructField("Customer_Job", S), T.StructField("Income", L),
    T.StructField("Cust_Satisfaction_Score", L),
])

# Header spellings seen in the shipped files and the DDL that
# must map onto the names the operators use.
HEADER_ALIASES = {
    "Use Chip": "Use_Chip",
    "Exp Type": "Exp_Type",
    "State_cd": "state_cd",
    "Contact": "contact",
    "Personal_Loan": "Personal_loan",
}


def canonical_name(name: str) -> str:
    """Strip BOM/blanks, apply the alias table, then blanks -> underscore."""
    n = name.replace("﻿", "").strip()
    n = HEADER_ALIASES.get(n, n)
    return n.replace(" ", "_")


def csv_read_schema(schema: T.StructType) -> T.StructType:
    """CSV files carry the date as dd-MM-yyyy text; read it as a string and parse it (B1)."""
    return T.StructType([
        T.StructField(f.name, S if isinstance(f.dataType, T.DateType) else f.dataType, True)
        for f in schema.fields
    ])
