"""op8 stores the media column and computes its features from what it reads back."""

import hashlib

from gridloom.llm import op8_media_flac


def test_query_reads_a_stored_media_table(spark, sf_dir):
    out = op8_media_flac.query(spark, sf_dir)
    files = out.inputFiles()
    assert files and all("/media-" in f for f in files)
    media = spark.read.parquet(files[0].rsplit("/", 1)[0])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert media.columns == ["doc_id", "n_bytes", "media"] and media.count() == docs.count()
    stored = sorted((r.doc_id, len(r.media), hashlib.sha256(bytes(r.media)).hexdigest()) for r in media.collect())
    assert sorted((r.doc_id, r.media_bytes, r.media_sha256) for r in out.collect()) == stored
