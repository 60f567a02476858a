from passbook.operators import integrity
from passbook.sources import ledgers


def test_rejected_rows_fail_completeness(spark, sf_dir):
    rows = ledgers.events(spark, sf_dir).where("seq = 1")
    audit = rows.selectExpr("acct", "9L as candidates", "if(acct % 2 = 0, 6L, 8L) as accepted_date_row", "1L as header_removed", "if(acct % 3 = 0, 3, 2) as suspicious", "0.5 as page_confidence")
    audit = integrity.accounting(audit)
    plain = {r["acct"]: r for r in integrity.status(rows).collect()}
    found = {r["acct"]: r for r in integrity.status(rows, audit).collect()}
    checks = {r["acct"]: r for r in integrity.checks(rows, audit=audit).collect()}
    assert {r["status"] for r in plain.values()} == {"GREEN"}
    for acct, r in found.items():
        whole = acct % 2 == 1 and acct % 3 != 0
        assert (checks[acct]["check_d"] == "PASS") == whole == (r["status"] == "GREEN")
        assert checks[acct]["completeness_ratio"] == (1.0 if acct % 2 else 0.7778)
        # More than two suspicious rows make a failure, not a minor discrepancy.
        assert r["status"] == ("GREEN" if whole else "RED" if acct % 3 == 0 else "YELLOW")
        assert round(plain[acct]["confidence"] - r["confidence"], 4) == (0.075 if whole else 0.25 if acct % 3 == 0 else 0.15)
        assert r["message"].endswith(f"completeness ratio {'100.0' if acct % 2 else '77.8'}% below threshold.") == (r["status"] == "RED")
