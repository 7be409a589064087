"""SRC1–SRC4 catalog helpers, ING16 audit rows and the SNK1 CSV sink."""

import datetime as dt
import os

from outletiq.operators import ingest as ING
from outletiq.sources import catalog as CAT
from outletiq.sources.tables import Tables


def test_catalog_listing_and_search(spark):
    Tables(spark, "/root/testdata/sf0.001").register_views(["region", "nation"])
    df = CAT.read_source(spark, "/root/testdata/sf0.001/region.parquet", view="region_src")
    assert df.count() == 5
    st = CAT.table_structure(spark)
    cols = {(r.table_name, r.column_name) for r in st.collect()}
    assert ("region", "r_name") in cols and ("nation", "n_regionkey") in cols
    hits = {r.column_name for r in CAT.search_structure(st, "REGION").collect()}
    assert {"r_regionkey", "r_name", "n_regionkey"} <= hits
    assert CAT.first_existing_table(spark, ["no_such_table", "nation", "region"]) == "nation"
    assert CAT.first_existing_table(spark, ["no_such_table"]) is None


def test_audit_row_and_csv_export(spark, tmpdir_run):
    a = ING.audit_row(spark, "success", 10, 2, "ASIA", "stock", "stock_fact",
                      dt.date(2001, 6, 1), dt.date(2001, 6, 30), "upsert")
    r = a.collect()[0]
    assert (r.status, r.rows_saved, r.rows_deleted, r.period_end) == ("success", 10, 2, dt.date(2001, 6, 30))
    out = os.path.join(tmpdir_run, "export")
    ING.export_csv(a.select("status", "rows_saved"), out)
    back = spark.read.option("header", True).csv(out).collect()
    assert [(x.status, x.rows_saved) for x in back] == [("success", "10")]
