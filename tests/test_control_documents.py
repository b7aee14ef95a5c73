"""Control documents as files: as many as pages of the account."""

from pyspark.sql import functions as F

from tidewater.plans import io_queries
from tidewater.sources import adapters as A
from tidewater.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_a_control_document_holds_a_page_of_the_account(spark, tmpdir_path):
    """As many files as pages, and the same tenant rows from them."""
    doc = fx.control_doc(spark, SF)
    docs = io_queries._account_documents(doc)
    pages = doc.where(F.size("datasets") > 0).select("page").distinct().count()
    assert docs.count() == pages + doc.where(F.size("datasets") == 0).count() < doc.count()
    assert docs.selectExpr("aggregate(tenants, 0, (n, t) -> n + size(t.datasets)) AS n").agg(F.max("n")).first()[0] <= 64
    docs.write.option("maxRecordsPerFile", 1).json(tmpdir_path + "/d")
    back = A.control_to_doc(A.read_control_documents(spark, tmpdir_path + "/d"))

    def flat(d):
        return sorted(d.select("tenant_id", "tenant_name", "active", F.to_json(F.array_sort(F.transform(
            "datasets", lambda x: F.struct(x["dataset_id"], x["name"], x["active"], F.to_json(x["config"]))))).alias("d")).collect())

    assert flat(back) == flat(doc)
