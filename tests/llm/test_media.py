import hashlib
import io
import tarfile
import zlib

import pyarrow.fs

from sheafline.llm import media, queries


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw + b"\xff" * (size - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith(f"576x{size // 576};")


def test_whole_table(spark, small):
    check(queries.op7_media_columns(spark, small).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()})


def test_odd_rows(docs, odd, none):
    rows = [(1, None), (2, ""), (3, "x" * 576), (4, "x" * 577), (5, "é\U0001f600" * 4000), (6, "x" * 576)]
    made = media.media_columns(docs(rows)).collect()
    check(made, dict(rows))
    by_id = {r.doc_id: r for r in made}
    assert by_id[3].digest == by_id[6].digest and by_id[1].digest == by_id[2].digest and (by_id[4].width, by_id[4].height) == (576, 2)
    assert media.media_columns(odd).count() == odd.count() and media.media_columns(none).count() == 0


def test_shards_are_tar_files_with_each_digest_once(docs, tmp_path):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    stored = media.stage(media.store(docs(rows).coalesce(1), f"file://{tmp_path}/shards"), "test-rows")
    places = stored.collect()
    shards = {p.shard for p in places}
    names = []
    for shard in shards:
        fs, path = pyarrow.fs.FileSystem.from_uri(shard)
        data = fs.open_input_file(path).readall()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for member in tar:
                names.append(member.name)
                assert hashlib.sha256(media.from_png(tar.extractfile(member).read())).hexdigest() + ".png" == member.name
    assert len(names) == len(set(names)) == 5
    heads = media.header_columns(stored).collect()
    assert len(heads) == 5 and all((h.width, h.height) == (576, 1) for h in heads)
