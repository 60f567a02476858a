from passbook.operators import reports


def test_profiles_stay_within_the_document(spark):
    accounts = spark.createDataFrame([(1, 10, 1, "abc"), (2, 20, 1, "abc"), (2, 21, 2, "xyz")], "doc_id long, acct long, pos long, connection string")
    profiles = spark.createDataFrame([(1, 1, "Bank ABC", "p"), (2, 1, "Other", "q"), (2, 2, "Bank ABC", "r")], "doc_id long, ord long, bank string, holder string")
    got = {r["acct"]: r["holder"] for r in reports.account_profiles(accounts, profiles).collect()}
    assert got == {10: "p", 20: "r", 21: "r"}
    join = reports.account_profiles(accounts, profiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in join
