"""The catalogue by JDBC: an in-memory database that comes with Spark."""

from flowlab.plans import views as V
from flowlab.sources import readers


def test_catalogue_by_jdbc(spark, small):
    options = {"url": "jdbc:derby:memory:flowlab;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    want = V.catalog(spark, small)
    for name, df in want.items():
        df.write.format("jdbc").options(**options, dbtable=name).mode("overwrite").save()
    got = readers.read_catalog(spark, options)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name].columns == want[name].columns
        assert got[name].count() == want[name].count() and got[name].exceptAll(want[name]).isEmpty(), name
    few = got["traces_metadata"].where("id < 500").select("filename")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,500)" in plan and "ReadSchema: struct<filename:string>" in plan
    assert few.count() == want["traces_metadata"].where("id < 500").count() > 0
