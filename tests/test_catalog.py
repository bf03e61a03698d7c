import hashlib
import io
import os
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

import loglake.operators.formats as formats_module
import loglake.plans.catalog as catalog_module
import loglake.sources.files as files_module
import loglake.streaming.ingest as stream_module
from loglake.operators.assembly import encoding_of_lines
from loglake.operators.intake import delete_files, delete_uploads, duplicate_report
from loglake.plans.catalog import Catalog, ingest
from loglake.session import many_small_files
from loglake.sources import archives, tables
from loglake.sources.archives import expand_archives, is_text_member, member_lines
from loglake.sources.encodings import decode_text, detect_encoding
from loglake.sources.files import content_keys, empty_files, list_files, open_files, read_blobs, read_lines
from loglake.streaming.ingest import ingest_stream

WEBLOGIC = ("####<Feb 9, 2021 11:04:59 AM CET> <Notice> <Cluster> <node7> <east1> <pool-3> <<anonymous>> <> <> "
            "<1612865099042> <BEA-000197> <Listening for peers>\r\n")
JAVA = "2020-10-05 08:30:11,204 INFO  [w-2] org.depot.Loader - 14 crates read\n\tat org.depot.Crate.open\nplain\n"
TWIN = b"first line of the twins\nsecond line of the twins\n"
RUSSIAN = "Ошибка соединения с сервером базы данных\nпривет\n"


def fill(folder):
    os.makedirs(folder)
    for name, data in {
        "a.log": WEBLOGIC.encode() * 3, "b.log": WEBLOGIC.encode() * 3, "c [1]+d.log": JAVA.encode(), "ru.log": RUSSIAN.encode("cp1251"),
        "bad.zip": b"PK\x03\x04garbage", "big.log": b"x" * 3000,
        # what tells whole files and files read by lines apart if their rules differ
        "late.log": b"all is well\n" * 90 + RUSSIAN.encode("iso8859-5"), "lf.log": TWIN, "crlf.log": TWIN.replace(b"\n", b"\r\n"),
        "bom.log": b"\xef\xbb\xbf" + TWIN, "open.log": TWIN[:-1], "empty.log": b"", "empty2.log": b"", "none.zip": b"", "blank.log": b"\n\n",
    }.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    with zipfile.ZipFile(f"{folder}/z.dat", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.log", WEBLOGIC)
        z.writestr("b/b.log", JAVA)
        z.writestr("b/x.bin", "no")
        z.writestr("c.log00010", WEBLOGIC * 2)
    return folder


def shape(cat):
    rows = cat.entries().join(cat.files().select(F.col("id").alias("file_id"), "filename", "path_in_archive"), "file_id")
    return sorted((r.filename, r.path_in_archive or "", r.seq, r.format, r.message) for r in rows.collect())


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalog"))
    report = ingest(spark, fill(root + "/in"), root + "/cat", "b1", max_bytes=2500, nest=True)
    return root, {r.filename: r for r in report.collect()}, Catalog(spark, root + "/cat")


def test_report(ingested):
    _, report, _ = ingested
    assert {name: r.status for name, r in report.items()} == {
        "a.log": "parsed", "b.log": "duplicate", "c [1]+d.log": "parsed", "ru.log": "parsed", "bad.zip": "failed", "big.log": "failed", "z.dat": "parsed",
        "late.log": "parsed", "lf.log": "parsed", "crlf.log": "parsed", "bom.log": "parsed", "open.log": "parsed", "empty.log": "parsed",
        "empty2.log": "duplicate", "none.zip": "duplicate", "blank.log": "parsed"}
    assert [(f.filename, f.record_count, f.summary.total_records) for f in report["empty.log"].files] == [("empty.log", 0, 0)]
    assert report["b.log"].existing_upload_id == report["a.log"].id
    assert "zip open" in report["bad.zip"].error and report["big.log"].files is None
    assert report["z.dat"].kind == "zip" and [f.filename for f in report["z.dat"].files] == ["a.log", "b.log", "c.log00010"]
    assert [f.record_count for f in report["z.dat"].files] == [1, 2, 2]


def test_tables(ingested):
    _, _, cat = ingested
    files = {(r.filename, r.path_in_archive): r for r in cat.files().collect()}
    ru, late, empty = (files[(name, None)] for name in ("ru.log", "late.log", "empty.log"))
    assert (ru.encoding, ru.format, ru.record_count, ru.pp_status) == ("Windows-1251", "text", 2, "done")
    assert (late.encoding, late.record_count) == ("ISO-8859-5", 92)
    assert (empty.encoding, empty.format, empty.record_count, empty.status, empty.md5) == ("UTF-8", "text", 0, "parsed", hashlib.md5().hexdigest())
    assert files[("b.log", "b/b.log")].summary.file_size == len(JAVA)
    rows = shape(cat)
    assert ("ru.log", "", 2, "text", "привет") in rows and ("late.log", "", 92, "text", "привет") in rows
    assert ("bom.log", "", 1, "text", "first line of the twins") in rows
    assert cat.uploads().count() == 12 and len(rows) == cat.entries().count() == 12 + 92 + 4 * 2
    assert cat.entries(cat.uploads().where("filename = 'z.dat'").first().id).count() == 5


def test_report_has_a_row_for_each_file(spark, ingested):
    root, _, _ = ingested
    rows = ingest(spark, root + "/in", root + "/flat", "b1", max_bytes=2500).collect()
    assert sorted((r.filename, r.file.filename) for r in rows if r.file) == sorted(
        [(n, n) for n in ("a.log", "c [1]+d.log", "ru.log", "late.log", "lf.log", "crlf.log", "bom.log", "open.log", "empty.log", "blank.log")]
        + [("z.dat", n) for n in ("a.log", "b.log", "c.log00010")])
    assert {r.filename for r in rows if not r.file} == {"b.log", "bad.zip", "big.log", "empty2.log", "none.zip"}


def test_sessions_are_stored(spark, tmp_path):
    line = WEBLOGIC.replace("Listening for peers", "{}")
    os.makedirs(tmp_path / "in")
    with open(tmp_path / "in" / "s.log", "w") as f:
        f.write(line.format("Server state changed to STARTING") + line.format("x") + line.format("Server state changed to FAILED").replace("1612865099042", "1612865109042"))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")
    cat = Catalog(spark, str(tmp_path / "cat"))
    row = cat.files().first()
    assert (row.summary.session_count, row.summary.session_sec) == (1, 10)
    assert [r.duration_sec for r in cat.sessions(row.id).collect()] == [10]


def everything(cat):
    """All of uploads, files and entries that doesn't hold a time of writing."""
    uploads = cat.uploads().drop("uploaded_at", "batch_id").collect()
    files = cat.files().drop("parsed_at", "pp_at", "batch_id").withColumn("summary", F.to_json(F.col("summary").dropFields("uploaded_at"))).collect()
    entries = cat.entries().withColumn("attrs", F.to_json("attrs")).collect()
    return [sorted(map(repr, rows)) for rows in (uploads, files, entries)]


@pytest.mark.parametrize("row_bytes", [10, 1 << 30])
def test_files_read_by_lines_give_the_same(spark, ingested, monkeypatch, row_bytes):
    """Thresholds decide how a file is read, never what comes out."""
    root, _, cat = ingested
    monkeypatch.setattr(catalog_module, "WHOLE_FILE_BYTES", 10)
    # archives need a row: those of the fixture are let through
    monkeypatch.setattr(catalog_module, "ROW_BYTES", row_bytes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        report = ingest(spark, root + "/in", f"{root}/long{row_bytes}", "b1", max_bytes=2500, nest=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    long, plain = everything(Catalog(spark, f"{root}/long{row_bytes}")), everything(cat)
    if row_bytes == 10:  # then archives are refused
        zipped = {r.id for r in report if r.filename in ("z.dat", "bad.zip")}
        assert {r.error for r in report if r.id in zipped} == {"archive is too large to be opened"}
        long, plain = ([[x for x in rows if not any(i in x for i in zipped)] for rows in y] for y in (long, plain))
    assert long == plain


def test_files_are_read_in_chunks(spark, ingested, monkeypatch, tmp_path):
    """Names pass through the driver a chunk at a time; the result is the same."""
    root, _, cat = ingested
    seen = []
    monkeypatch.setattr(catalog_module, "CHUNK_FILES", 3)
    monkeypatch.setattr(catalog_module, "literal_paths", lambda rows: seen.append(files_module.literal_paths(rows)) or seen[-1])
    ingest(spark, root + "/in", str(tmp_path), "b1", max_bytes=2500)
    assert everything(Catalog(spark, str(tmp_path))) == everything(cat)
    assert len(seen) > 3 and max(map(len, seen)) <= 7 and sum(map(len, seen)) == 11
    ingest(spark, root + "/in", str(tmp_path), "b1", max_bytes=2500)  # and so is that of a rerun
    assert everything(Catalog(spark, str(tmp_path))) == everything(cat)


def test_second_batch_rerun_and_deletion(spark, ingested):
    root, _, _ = ingested
    folder = root + "/more"
    ingest(spark, root + "/in", folder, "b1", max_bytes=2500)
    again = {r.filename: r.status for r in ingest(spark, root + "/in", folder, "b2").collect()}
    assert again.pop("big.log") == "parsed" and set(again.values()) == {"duplicate"}
    cat = Catalog(spark, folder)
    before, all_of_it = shape(cat), everything(cat)
    ingest(spark, root + "/in", folder, "b2")  # a replayed batch replaces itself
    assert shape(cat) == before and len(before) == 113
    upload = cat.uploads().where("filename = 'z.dat'").first().id
    file_id = cat.files().where("filename = 'ru.log'").first().id
    cat.delete_uploads([upload])
    cat.delete_files([file_id])
    assert len(shape(cat)) == 113 - 5 - 2
    assert cat.uploads().where("filename = 'ru.log'").count() == 1 and cat.files().where("filename = 'ru.log'").count() == 0
    with pytest.raises(KeyError):
        cat.delete_uploads([upload])
    with pytest.raises(ValueError):
        ingest(spark, root + "/in", folder, "b3", max_files=3)
    again = {r.filename: r.status for r in ingest(spark, root + "/in", folder, "b4").collect()}
    assert again["z.dat"] == "parsed" and again["a.log"] == "duplicate"
    cat.delete_uploads([cat.uploads().where("filename = 'z.dat'").first().id])
    ingest(spark, root + "/in", folder, "b1", max_bytes=2500)  # running a batch again undoes deletions from it
    assert everything(cat) == all_of_it


def test_resummarize_with_other_markers(spark, tmp_path):
    line = WEBLOGIC.replace("Listening for peers", "{}")
    os.makedirs(tmp_path / "in")
    with open(tmp_path / "in" / "s.log", "w") as f:
        for i, text in enumerate(["Server state changed to STARTING", "Gates Open", "x", "gates closed", "Server state changed to FAILED"]):
            f.write(line.format(text).replace("1612865099042", str(1612865099042 + 1000 * i)))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")
    cat = Catalog(spark, str(tmp_path / "cat"))
    state = lambda: [(r.summary.session_count, r.summary.session_sec, r.duration_sec) for r in cat.files().collect()] + [
        r.duration_sec for r in cat.sessions().collect()]
    assert state() == [(1, 4, 4), 4]
    markers = spark.createDataFrame([("weblogic", "start", "gates open"), ("weblogic", "stop", "GATES CLOSED"), ("java", "start", "")], "format string, kind string, text string")
    done = cat.resummarize("r1", markers=markers).collect()
    assert len(done) == 1 and state() == [(1, 2, 4), 2] and cat.sessions(done[0].id).count() == 1
    cat.resummarize("r2")  # the markers are kept
    assert state() == [(1, 2, 4), 2]
    cat.resummarize("r3", [done[0].id], markers={"weblogic": (["nothing"], ["like it"])})
    assert state() == [(0, 0, 4)]
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat2"), "b1", markers=markers)
    assert [r.duration_sec for r in Catalog(spark, str(tmp_path / "cat2")).sessions().collect()] == [2]
    with pytest.raises(Exception, match="start or stop"):
        cat.resummarize("r4", markers=spark.createDataFrame([("weblogic", "begin", "x")], "format string, kind string, text string"))


def test_view_state_is_stored_and_goes_with_its_upload(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.log").write_text(f"{name}\n")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")
    cat = Catalog(spark, str(tmp_path / "cat"))
    a, b = (cat.uploads().where(f"filename = '{n}.log'").first().id for n in "ab")
    one = lambda rows, names: spark.createDataFrame(rows, names)
    assert cat.save_view("filters", one([("f1", a, "search", "{}"), ("f2", b, "search", "{}")], "id string, upload_id string, kind string, rule string"), "r1").count() == 0
    assert cat.save_view("highlights", one([("h1", a, "x", "red")], "id string, upload_id string, text string, color string"), "r1").count() == 0
    assert cat.save_view("presets", one([("p1", a, "n", "{}")], "id string, upload_id string, name string, snapshot string"), "r1").count() == 0
    pins = one([("n1", a, "f", 1, "note", "red"), ("n2", a, "f", None, "note", "red"), ("n3", "gone", "f", 1, "note", "red"), (None, a, "f", 1, "note", "red"),
                ("n4", b, "f", 1, "", "red")], "id string, upload_id string, file_id string, entry_id long, note string, color string")
    refused = {r.id: r.error for r in cat.save_view("annotations", pins, "r1").collect()}
    assert set(refused) == {"n2", "n3", "n4", None} and refused["n3"] == "no such upload" and refused[None] == "id is required"
    ids = lambda: {t: sorted(r.id for r in cat.view(t).collect()) for t in ("filters", "highlights", "presets", "annotations")}
    assert ids() == {"filters": ["f1", "f2"], "highlights": ["h1"], "presets": ["p1"], "annotations": ["n1"]}
    cat.clear_view_state(a)
    assert ids() == {"filters": ["f2"], "highlights": [], "presets": ["p1"], "annotations": ["n1"]}
    cat.delete_files([cat.files().where("filename = 'a.log'").first().id])
    assert ids()["annotations"] == ["n1"]  # it dangles
    cat.delete_uploads([a])
    assert ids() == {"filters": ["f2"], "highlights": [], "presets": [], "annotations": []}
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")  # brings the upload back, not its view
    assert cat.uploads().count() == 2 and cat.files().count() == 2 and ids()["presets"] == []
    cat.delete_view("filters", ["f2"])
    assert ids()["filters"] == []
    with pytest.raises(KeyError):
        cat.delete_view("filters", ["f2"])


@pytest.mark.parametrize("limit", [{"files_per_trigger": 3}, {"bytes_per_trigger": 600}])
def test_stream(spark, ingested, tmp_path, limit):
    root, _, _ = ingested
    folder = str(tmp_path / "cat")
    for _ in range(2):
        query = ingest_stream(spark, root + "/in", folder, str(tmp_path / "check"), max_bytes=2500, available_now=True, **limit)
        query.awaitTermination()
    cat = Catalog(spark, folder)
    assert cat.entries().count() == 112
    assert cat.uploads().where("filename = 'empty.log'").count() == 1 == cat.uploads().where("size_bytes = 0").count()
    assert cat.uploads().select("batch_id").distinct().count() >= 2


@pytest.mark.parametrize("own", [True, False])
def test_names_of_a_stream_do_not_come_to_the_driver(spark, tmp_path, monkeypatch, own):
    """They go to the batch's listing; in a store whose files tasks can't open, the names of a micro-batch do come."""
    (tmp_path / "in" / "d").mkdir(parents=True)
    for i in range(30):
        (tmp_path / "in" / "d" / f"{i} [x]+%41.log").write_text(f"line {i // 2}\n")
    for name in ("a.log", "b.log"):
        (tmp_path / "in" / name).write_text("")
    seen = []
    monkeypatch.setattr(stream_module, "literal_paths", lambda rows: seen.append(files_module.literal_paths(rows)) or seen[-1])
    if not own:
        for module in (files_module, stream_module):
            monkeypatch.setattr(module, "mounted", lambda s, p: None)
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "cat"), str(tmp_path / "check"), files_per_trigger=20, available_now=True).awaitTermination()
    assert sum(map(len, seen)) == (0 if own else 31)
    cat = Catalog(spark, str(tmp_path / "cat"))
    assert sorted(r.message for r in cat.entries().collect()) == sorted(f"line {i}" for i in range(15))
    assert [r.filename for r in cat.uploads().where("size_bytes = 0").collect()] == ["a.log"] and cat.uploads().count() == 16


def test_readers(spark, ingested):
    root, _, _ = ingested
    listed = {r.filename: r.length for r in list_files(spark, root + "/in").collect()}
    assert listed["big.log"] == 3000 and "c [1]+d.log" in listed and listed["empty.log"] == 0 and len(listed) == 16
    assert {r.path.split("/")[-1] for r in empty_files(spark, root + "/in").collect()} == {"empty.log", "empty2.log", "none.zip"}
    assert "big.log" not in {r.filename for r in read_blobs(spark, root + "/in", 2500).select("filename").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = read_lines(spark, root + "/in/a.log").orderBy("block", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in rows] == [WEBLOGIC.rstrip()] * 3
    assert len({r.block for r in rows}) > 1


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_content_key_is_the_md5_of_the_bytes(spark, tmp_path, monkeypatch, piece):
    contents = {"a": b"x\ny", "b": b"x\ny\n", "c": b"x\r\ny\r\n", "d": b"\n", "e": b"\n\n\n", "f": b"\xef\xbb\xbfx\n", "g": b"\xef\xbb\xbfx",
                "h": b"PK\x03\x04" + bytes(range(256)) * 40, "i": b"\xff\n" * 500, "j": b"z" * 3000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(files_module, "PIECE_BYTES", piece)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = content_keys(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.path[-1]: (r.md5, r.zip) for r in rows} == {n: (hashlib.md5(d).hexdigest(), n == "h") for n, d in contents.items()}


def archive(members, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(buffer, "w", method) as z:
        warnings.simplefilter("ignore")  # the same name twice
        for name, data in members:
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.parametrize("part,inflate", [(1, 1), (50, 7), (4 << 20, 1 << 20)])
def test_archives_are_inflated_member_by_member(spark, monkeypatch, part, inflate):
    monkeypatch.setattr(archives, "PART_BYTES", part)
    monkeypatch.setattr(archives, "INFLATE_BYTES", inflate)
    long = b"".join(b"line %d\r\n" % i for i in range(90)) + b"no end"
    good = archive([("a.log", b"one\n"), ("d/", b""), ("a.log", b"two\n" * 30), ("d/b.bin", b"no"), ("e.log", b""), ("d/long.log", long)])
    damaged = bytearray(archive([("a.log", b"one" * 50), ("b.log", b"all right")], zipfile.ZIP_STORED))
    damaged[40] ^= 1
    packed = archive([("x.log", b"x" * 500)], zipfile.ZIP_BZIP2)
    rows = [("good", good), ("damaged", bytes(damaged)), ("bzip", packed), ("none", b"PK\x03\x04no"), ("stored", archive([("s.log", long)], zipfile.ZIP_STORED)), ("bare", archive([]))]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "id string, content binary")
    found = {(r.id, r.member): r for r in expand_archives(df, "id", 200).collect()}
    assert {k: r.content and bytes(r.content) for k, r in found.items() if k[0] == "good"} == {
        ("good", 0): b"one\n", ("good", 2): b"two\n" * 30, ("good", 4): b"", ("good", 5): None}
    big = found[("good", 5)]
    assert (big.member_name, big.size_bytes, big.md5, big.error) == ("long.log", len(long), hashlib.md5(long).hexdigest(), None)
    assert "not those that were packed" in found[("damaged", 0)].error and bytes(found[("damaged", 1)].content) == b"all right"
    assert "method 12" in found[("bzip", 0)].error and "zip open" in found[("none", None)].archive_error and len(found) == 9
    lines = member_lines(df, "id", 200, block_bytes=100).where("id in ('good', 'stored')").orderBy("id", "member", "block", "pos").collect()
    want = [f"line {i}" for i in range(90)] + ["no end"]
    assert [r.value for r in lines] == want + want and len({r.block for r in lines}) > 5


def test_members_of_the_same_name_and_long_members(spark, tmp_path, monkeypatch):
    os.makedirs(tmp_path / "in")
    members = [("a.log", WEBLOGIC), ("a.log", WEBLOGIC * 3), ("ru.log", b"all is well\n" * 50 + RUSSIAN.encode("cp1251")), ("j.log", JAVA * 9)]
    (tmp_path / "in" / "same.zip").write_bytes(archive(members))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "whole"), "b1")
    monkeypatch.setattr(catalog_module, "WHOLE_FILE_BYTES", 300)
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "lines"), "b1")
    cat = Catalog(spark, str(tmp_path / "whole"))
    assert sorted((r.filename, r.record_count, r.encoding) for r in cat.files().collect()) == [
        ("a.log", 1, "UTF-8"), ("a.log", 3, "UTF-8"), ("j.log", 18, "UTF-8"), ("ru.log", 52, "Windows-1251")]
    assert cat.entries().count() == cat.entries().select("file_id", "seq").distinct().count() == 74
    assert everything(cat) == everything(Catalog(spark, str(tmp_path / "lines")))


@pytest.mark.parametrize("name,text,encoding", [
    ("Windows-1251", RUSSIAN, "cp1251"), ("ISO-8859-5", RUSSIAN, "iso8859-5"), ("ISO-8859-1", "café très élevé à côté", "latin-1"),
    ("ISO-8859-1", "Éèé êéè menté éan êéé éanier", "latin-1"), ("Windows-1251", "ERROR main - Ошибка: нет места", "cp1251"),
    ("Windows-1252", "price 5€ – café", "cp1252"), ("UTF-8", "hello мир", "utf-8"), ("UTF-8", "", "utf-8"),
    ("Windows-1251", "plain words\n" * 9000 + RUSSIAN, "cp1251"),
])
def test_encodings(spark, name, text, encoding):
    df = spark.createDataFrame([(bytearray(text.encode(encoding)),)], "content binary")
    row = df.withColumn("e", detect_encoding(F.col("content"))).withColumn("t", decode_text(F.col("content"), F.col("e"))).first()
    assert (row.e, row.t) == (name, text)
    lines = spark.createDataFrame([("f", 0, i, bytearray(x)) for i, x in enumerate(text.encode(encoding).split(b"\n"))], "file_id string, block long, pos long, value binary")
    assert encoding_of_lines(lines.repartition(3)).first().encoding == name


def test_unknown_encoding_is_read_as_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "content binary")
    assert df.select(decode_text(F.col("content"), F.lit("KOI8-R")).alias("t")).first().t == "a�b"


def test_member_names():
    assert all(map(is_text_member, ["a.log", "d/b.OUT", "c.log00010", "README", "x.err1"]))
    assert not any(map(is_text_member, ["a.bin", "b.log.gz", "c.log0a"]))


def test_duplicates(spark):
    batch = spark.createDataFrame(
        [("1", "b", "m1", 5), ("2", "a", "m1", 5), ("3", "c", "m2", 5), ("4", "d", "m3", 50), ("5", "e", "m4", 5)] +
        [(str(100 + i), f"z{i}", "hot", 5) for i in range(200)], "id string, filename string, md5 string, size_bytes long")
    known = spark.createDataFrame([("old", "m2")], "id string, md5 string")
    rows = {r.id: (r.status, r.existing_upload_id) for r in duplicate_report(batch, known, 10).collect()}
    assert rows["2"] == ("accepted", None) and rows["1"] == ("duplicate", "2") and rows["3"] == ("duplicate", "old")
    assert rows["4"] == ("failed", None) and rows["5"] == ("accepted", None)
    assert rows["100"] == ("accepted", None) and sum(v == ("duplicate", "100") for v in rows.values()) == 199


def test_cascade(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "uploads": one([("u",), ("v",)], "id string"), "files": one([("f", "u"), ("g", "v")], "id string, upload_id string"),
        "entries": one([("u", "f"), ("v", "g")], "upload_id string, file_id string"),
        "filters": one([("1", "u")], "id string, upload_id string"), "annotations": one([("1", "v")], "id string, upload_id string"),
    }
    left = delete_uploads(tables, one([("u",)], "id string"))
    assert {k: v.count() for k, v in left.items()} == {"uploads": 1, "files": 1, "entries": 1, "filters": 0, "annotations": 1}
    left = delete_files(tables, one([("g",)], "id string"))
    assert {k: v.count() for k, v in left.items()} == {"uploads": 2, "files": 1, "entries": 1, "filters": 1, "annotations": 1}


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Reading and listing don't cost a task for a few files or a folder each, and a batch lists its folders once."""
    for i in range(200):
        os.makedirs(tmp_path / "in" / f"d{i}")
        (tmp_path / "in" / f"d{i}" / "a.log").write_text(f"line {i}\n")
    tracker, listed = spark.sparkContext.statusTracker(), []
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    tasks = lambda: sum(
        stage.numTasks for job in tracker.getJobIdsForGroup("small") for i in tracker.getJobInfo(job).stageIds if (stage := tracker.getStageInfo(i)))
    spark.sparkContext.setJobGroup("small", "small files")
    try:
        with many_small_files(spark):
            found = open_files(spark, str(tmp_path / "in"))
            assert found.rdd.getNumPartitions() < 10
        listed.append(tasks())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert listed[0] <= 4 * spark.sparkContext.defaultParallelism + 4
    assert open_files(spark, found) is found and list_files(spark, found).count() == 200
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    report = ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")
    assert report.where("status = 'parsed'").count() == 200 and Catalog(spark, str(tmp_path / "cat")).entries().count() == 200


def test_documents_as_files(spark, tmp_path):
    """A file for each doc_id, null and repeated ids, too, with its texts as lines, in few folders."""
    rows = [(i, f"text {i}\nрусский" if i % 3 else "") for i in range(2500)] + [(7, "again"), (None, "a"), (None, "b"), (9000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tables.write_documents(spark, str(tmp_path), f"file://{tmp_path}/own")
    expected = {}
    for doc_id, text in rows:
        expected[doc_id] = expected.get(doc_id, b"") + (text or "").encode() + b"\n"
    stored = [open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(tmp_path / "own") for n in names]
    assert sorted(stored) == sorted(expected.values())
    assert len(os.listdir(tmp_path / "own")) == 3


def test_a_batch_finds_its_files_once(spark, tmp_path, monkeypatch):
    """Accepted files are read from the listing there is, not looked for by their names again; odd names, too."""
    (tmp_path / "in").mkdir()
    names = ["a[1].log", "b{x,y}.log", "c*.log", "d?.log", "e\\f.log", "g+ %41.log", "copy.log"]
    for i, name in enumerate(names):
        (tmp_path / "in" / name).write_text("line 0\n" if name == "copy.log" else f"line {i}\nmore\n" if i else "line 0\n")
    loaded, load = [], catalog_module.open_files
    monkeypatch.setattr(catalog_module, "CHUNK_FILES", 2)
    monkeypatch.setattr(catalog_module, "open_files", lambda s, p: loaded.append(p) or load(s, p))
    reader = files_module.open_files
    monkeypatch.setattr(files_module, "open_files", lambda s, p: loaded.append(p) if isinstance(p, list) else reader(s, p))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "cat"), "b1")
    assert loaded == [str(tmp_path / "in")]
    cat = Catalog(spark, str(tmp_path / "cat"))
    assert sorted(r.filename for r in cat.files().collect()) == sorted(set(names) - {"copy.log"})
    assert sorted(r.message for r in cat.entries().collect()) == sorted([f"line {i}" for i in range(6)] + ["more"] * 5)


def listed(spark, paths):
    """(path, length) of files as tasks find them and as Spark's source knows them."""
    found = [(r.path, r.length) for r in list_files(spark, paths).collect()]
    known = list_files(spark, files_module._spark_files(spark, paths))
    return sorted(found), sorted((r.path, r.length) for r in known.collect())


def test_names_of_a_batch_do_not_come_to_the_driver(spark, tmp_path):
    """Tasks find the files of mounted folders, the same as Spark's source, of which the driver keeps an index."""
    deep = tmp_path / "in" / "a" / "b=1" / "c [1]" / "d+%41" / "e"
    deep.mkdir(parents=True)
    for i in range(40):
        (deep / f"{i}.log").write_text("x" * i)
    for name in (".hidden", "_hidden", "_k=1", "x._COPYING_", "é \u0416.log", "q?.log", "s*{a,b}.log"):
        (tmp_path / "in" / name).write_text(name)
    for name in (".git", "_tmp"):
        (tmp_path / "in" / name).mkdir()
        (tmp_path / "in" / name / "f.log").write_text("no")
    with open(os.fsencode(tmp_path / "in") + b"/no \xff text.log", "wb"):
        pass
    os.symlink(deep / "7.log", tmp_path / "in" / "link.log")
    os.symlink(tmp_path / "gone", tmp_path / "in" / "dangling.log")
    os.symlink(deep, tmp_path / "in" / "folder")
    root = str(tmp_path / "in")
    found = open_files(spark, root)
    assert not found.inputFiles()
    for paths in (root, f"file://{root}/", [root, f"{root}/a"], f"{root}/a/*/c*", f"{root}/q\\?.log", [f"{root}/q?.log", f"{root}/s\\*\\{{a,b\\}}.log"], f"{root}/link.log"):
        assert len(set(here := listed(spark, paths)[0])) == len(here) > 0 and here == listed(spark, paths)[1], paths
    assert len(listed(spark, root)[0]) == 85
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_files(spark, root + "/none")


def test_files_of_other_stores_give_the_same(spark, ingested, monkeypatch, tmp_path):
    """Files that tasks can't open by their names are read by Spark's source."""
    root, _, cat = ingested
    monkeypatch.setattr(files_module, "mounted", lambda s, p: None)
    monkeypatch.setattr(catalog_module, "CHUNK_FILES", 4)
    ingest(spark, root + "/in", str(tmp_path / "cat"), "b1", max_bytes=2500)
    assert everything(Catalog(spark, str(tmp_path / "cat"))) == everything(cat)


def test_entries_of_a_batch_stay_in_many_tasks(spark, ingested):
    """They are not shuffled by their batch, whatever the size of the uploads table."""
    _, _, cat = ingested
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = cat.entries()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_parts_of_a_format_are_built_once(spark):
    """Building the expressions of a format is most of what the driver does for a batch."""
    calls = []
    spec = formats_module.FormatSpec(
        "once", head="once ", groups=lambda r: F.array(r.raw), take=lambda r: calls.append(1) or dict(message=r.group(0)))
    rows = spark.createDataFrame([("once", "once a")], "format string, raw_line string")
    parsed = formats_module.parse_fields(rows, [spec], "UTC")
    assert [r.message for r in parsed.collect()] == ["once a"] and len(calls) == 1
