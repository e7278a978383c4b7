import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    s = local_session("*", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """The 11 x 9 sample customers file, read like any CSV (all strings, then promotion)."""
    from tessera.sources.io import read_any
    return read_any(spark, os.path.join(FIXTURES, "sample_customers.csv"))


#: Loans of a library: what each row holds beside its key is listed in ``LOAN_FACTS`` of test_function_profile.
LOANS = [
    (11, "loan-11", "mara.k@lib.example", 8, 0, "538-20-7714", "returned, card 4556 7375 8689 9855 left on desk"),
    (12, "loan-12", "no address", 131, 3, "A-77", "identity checked: 219-09-9999 (passport shown)"),
    (13, None, "t@lib.example", 44, -2, "415 555 0132 7", "ring 212-555-0187 before noon"),
    (14, "loan-14", None, 17, 12, None, "joined 7/4/1998"),
    (15, "loan-15", "p@lib", -1, 5, "B-12", None),
]


@pytest.fixture
def loans(spark):
    schema = "row_key bigint, loan_id string, user_email string, reader_age bigint, fee_amount bigint, item_code string, desk_notes string"
    return spark.createDataFrame(LOANS, schema)
