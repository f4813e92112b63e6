from quadrille.operators.store import GraphStore
from quadrille.sources.files import read_documents, read_ntriples, write_ntriples
from quadrille.streaming.ingest import ingest

QUADS = "s string, p string, o string, g string"


def test_files_round_trip(spark, tmp_path):
    rows = [("<http://e/a>", "<http://e/p>", '"say "hi"\nthere\\"', None), ("_:b1", "<http://e/p>", "<< <http://e/a> <http://e/p> <http://e/b> >>", None)]
    write_ntriples(spark.createDataFrame(rows, QUADS), f"{tmp_path}/out")
    got = {(r["p"], r["o"]) for r in read_ntriples(spark, f"{tmp_path}/out").collect()}
    assert got == {(r[1], r[2]) for r in rows}


def test_documents(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <http://e/> . :a :p ( 1 2 ) .")
    assert read_documents(spark, f"{tmp_path}/a.ttl", graph="<urn:g>").where("g = '<urn:g>'").count() == 5
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:P rdf:about="http://e/x"/></rdf:RDF>')
    assert read_documents(spark, f"{tmp_path}/a.rdf", "rdfxml").count() == 1


def test_stream(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([("<http://e/a>", "<http://e/p>", f'"{i}"', None), ("<http://e/a>", "<http://e/p>", '"same"', None)], QUADS).write.mode("append").parquet(f"{tmp_path}/in")
    store = GraphStore(spark)
    ingest(spark.readStream.schema(QUADS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/state").awaitTermination(120)
    assert store.rdf_count() == 3
