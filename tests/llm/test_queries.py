"""The registered queries on the smallest tables: SQL twins where there are any, and the columns they return."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from haulgrid.llm.queries import QUERIES
from haulgrid.session import released
from tools.check_oracles import TABLES, compare

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")

COLUMNS = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean",
    "op5": "query_id bigint, rank int, vec_id bigint, score double",
    "op6": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8": "page_id bigint, host string, path string, rule string, verdict string",
    "op9": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
    "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12": "doc_id bigint, fingerprint string, component_id bigint",
    "op13": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    with released(spark):
        assert compare(spark, con, DATA, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.split("_")[0] in COLUMNS])
def test_columns(spark, name):
    with released(spark):
        kinds = dict(entry.queries()[name](spark, DATA).dtypes)
    for column in COLUMNS[name.split("_")[0]].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, column


def test_the_pipeline_is_registered():
    assert "pipeline" in entry.queries()
