"""CSV scans go by header, and lines that do not fit are set aside."""

import pytest

from cardlens.sources import csv
from cardlens.sources.schema import CUST_SCHEMA

NAMES = [f.name for f in CUST_SCHEMA.fields]
ROW = dict(zip(NAMES, ["1", "45", "F", "2", "Graduate", "Married ", "NY", "00123", "yes", "no", "no", "cellular", "Govt", "60000", "4"]))


def _write(path, names, *lines, aliases={}):
    head = ",".join(aliases.get(n, n) for n in names)
    path.write_bytes(("\ufeff" + "\r\n".join([head, *lines]) + "\r\n").encode())
    return str(path)


def _line(names, **change):
    return ",".join({**ROW, **change}.get(n, "x") for n in names)


def test_columns_go_by_header(spark, tmp_path):
    swapped = NAMES[::-1] + ["Extra"]
    path = _write(tmp_path / "c.csv", swapped, _line(swapped), _line(swapped, Client_Num="2"),
                  aliases={"state_cd": "State_cd", "contact": "Contact", "Personal_loan": "Personal Loan".replace(" ", "_")})
    rows = csv.read_cust_csv(spark, path).orderBy("Client_Num").collect()
    assert [r.Client_Num for r in rows] == [1, 2]
    assert rows[0].asDict() == {"Client_Num": 1, "Customer_Age": 45, "Gender": "F", "Dependent_Count": 2, "Education_Level": "Graduate",
                                "Marital_Status": "Married", "state_cd": "NY", "Zipcode": "00123", "Car_Owner": "yes", "House_Owner": "no",
                                "Personal_loan": "no", "contact": "cellular", "Customer_Job": "Govt", "Income": 60000,
                                "Cust_Satisfaction_Score": 4}


def test_missing_and_repeated_columns_are_refused(spark, tmp_path):
    with pytest.raises(csv.BadHeader, match="Income"):
        csv.read_cust_csv(spark, _write(tmp_path / "m.csv", [n for n in NAMES if n != "Income"]))
    with pytest.raises(csv.BadHeader, match="twice"):
        csv.read_cust_csv(spark, _write(tmp_path / "d.csv", [*NAMES, "Contact"]))


def test_bad_lines_are_rejected_not_nulled(spark, tmp_path):
    short, text = "7,45,F", _line(NAMES, Client_Num="8", Income="much")
    path = _write(tmp_path / "b.csv", NAMES, _line(NAMES), short, text, _line(NAMES, Client_Num="9", Income=""))
    rows = csv.read_cust_csv(spark, path)
    assert sorted(r.Client_Num for r in rows.collect()) == [1, 9]
    assert rows.select("Client_Num").count() == 2
    assert sorted(r.line for r in csv.rejects(spark, path, CUST_SCHEMA).collect()) == sorted([short, text])
