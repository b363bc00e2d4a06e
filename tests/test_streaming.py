from pyspark.sql import functions as F

from riskloom.operators.profiles import profile_all
from riskloom.streaming.scoring import profile_stream, write_available

HOST = ("id long, tipoModeloFA string, scoreBuroFA int, saldoCuentasFA double, tipoModelo12D string, "
        "scoreBuro12D int, saldoCuentas12D double, avgSaldoCuentasU3M double, avgSaldoCuentasU6M double")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    def rows(start):
        return spark.createDataFrame(
            [(i, ["CE", "SE", None][i % 3], 800 + i, float(7 * i), "SE", 900 + i, None, float(i), 500.0 - i)
             for i in range(start, start + 60)], HOST)

    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows(0).write.parquet(source)
    stream = profile_stream(spark.readStream.schema(HOST).parquet(source))
    write_available(stream, target, mark).awaitTermination()
    rows(60).write.mode("append").parquet(source)
    write_available(stream, target, mark).awaitTermination()
    got, expected = spark.read.parquet(target), profile_all(spark.read.parquet(source))
    assert got.count() == 120
    assert got.exceptAll(expected).count() == 0
    assert got.filter(F.col("perfilesReglas12D") == "Sin Perfil").count() == 120
