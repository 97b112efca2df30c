"""Every registered query against its checking SQL.

POSTLENS_SF picks the data folder, POSTLENS_QUERIES a comma list of name parts
("all" for everything); by default a cross-section runs on the smallest data.
"""

import os

import pytest

from postlens.catalog import ORACLES, QUERIES
from postlens.catalog.check import compare, duck

ROOT = os.environ.get("POSTLENS_SF", "/root/testdata/sf0.001")
DEFAULT = "prj_2,prj_12,flt_1,jn_6,ag_13,wn_1,wn_8,bi_3,bi_9,bi_16,bi_17,lc_2,lc_8,qlt_3,snk_1,snk_2,txt_2_,txt_8,txt_16,dup_3,dup_4,mat_1_knn,mat_9,src_2,src_4"
PARTS = os.environ.get("POSTLENS_QUERIES", DEFAULT)
NAMES = [n for n in QUERIES if PARTS == "all" or any(n.startswith(p) for p in PARTS.split(","))]

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, ROOT)
    assert ok, note


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
