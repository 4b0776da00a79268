import json

import pytest
from glyphsift.sources.specimens import elf64
from pyspark.sql import functions as F
from test_formats import elf

from glyphsift import cli, queries
from glyphsift.functions import classify, demangle, rank, sections
from glyphsift.operators import dedup, extract, select
from glyphsift.plans import pipeline, sinks
from glyphsift.sources import binaries, config
from glyphsift.streaming import arrivals


def column(spark, expression, *rows, names="x string"):
    return [r[-1] for r in spark.createDataFrame(list(rows), names).withColumn("got", expression).collect()]


def test_section_tables(spark):
    for rows, names, expression in (
        (queries.ELF_ROWS, "a string, b long, c string", sections.elf_section_type(F.col("a"), F.col("b"))),
        (queries.PE_ROWS, "a string, b long, c string", sections.pe_section_type(F.col("a"), F.col("b"))),
        (queries.MACHO_ROWS, "a string, b string, c string", sections.macho_section_type(F.col("a"), F.col("b"))),
    ):
        assert column(spark, expression, *rows, names=names) == [r[2] for r in rows]
    pairs = (("__TEXT", "__text"), ("__DATA", "__data"), ("__TEXT", "__cstring"), ("__DATA_DIRTY", "x"), ("__DATA_CONST", "x"))
    assert column(spark, sections.macho_executable(F.col("a"), F.col("b")), *pairs, names="a string, b string") == [True, False, False, False, False]
    assert column(spark, sections.macho_writable(F.col("a")), *pairs, names="a string, b string") == [False, True, False, True, False]


@pytest.mark.parametrize(
    ("text", "tags"),
    [
        ("http://garden.io/beds", ["url", "filepath"]),
        ("https:/garden.io", ["domain", "filepath"]),  # one slash is no scheme
        ("beds.garden.tech", ["domain"]),
        ("beds.garden.invalidtld", []),
        ("garden.io", ["domain"]),
        ("9.255.0.31", ["ipv4"]),
        ("9.256.0.31", []),
        ("8.8.4.4é", []),  # a letter beyond ASCII is part of a word
        ("fe80::4", []),
        ("fe80:0:0:0:1:2:3:4", ["ipv6"]),
        ("/", ["filepath"]),
        ("D:\\Garden", ["filepath"]),
        ("D:Garden", []),
        ("HKEY_USERS\\Garden", ["regpath"]),
        ("{0A1B2C3D-4E5F-6071-8293-A4B5C6D7E8F9}", ["guid"]),
        ("%4d beds", ["fmt"]),
        ("beds {12}", ["fmt"]),
        ("100% {}", []),
        ("Um9zZXMgYW5kIHR1bGlwcyBpbiByb3dz", ["b64"]),
        ("Um9zZXM=", []),
        ("", []),
    ],
)
def test_tags(spark, text, tags):
    assert column(spark, classify.tags(F.col("x"), F.lit("StringData"), F.lit("SectionData")), (text,)) == [tags]


def test_custom_classifier(spark):
    own = lambda text: F.when(text.contains("secret"), F.lit("secret"))
    assert column(spark, classify.tags(F.col("x"), F.lit("Other"), F.lit("SectionData"), classifiers=[own]), ("my secret",)) == [["secret"]]


def test_scores_stay_in_bounds(spark):
    rows = queries.found(spark, "/root/testdata/sf0.001", "documents", "html")
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 100


def test_char_stats_agree(spark):
    raw = queries.runs(spark, "/root/testdata/sf0.001", "conversations").limit(200)
    printable, entropy, top = rank.char_stats(F.col("text"))
    gap = raw.select(F.max(F.abs(printable - F.col("printable"))), F.max(F.abs(entropy - F.col("entropy"))), F.max(F.abs(top - F.col("top_share")))).first()
    assert max(gap) < 1e-9


def sections_of(spark, *contents):
    return spark.createDataFrame([(str(i), "Unknown", "s", "StringData", 0, None, "SectionData", c) for i, c in enumerate(contents)], "path string, format string, section string, section_type string, base_offset long, base_rva decimal(20,0), source string, content binary")


def test_offsets_name_the_bytes(spark):
    wide = "wide text".encode("utf-16-le")
    data = b"\x01\x02" + b"plain one\x00\x00\x00" + wide + b"\x00\x00\xff" + "über".encode() + b"\x00ends here"
    how = extract.Extraction(encodings=("all",))
    got = extract.scan(sections_of(spark, data, b"", None, b"abc", b"====="), how).collect()
    codecs = {"ascii": "ascii", "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
    for r in got:
        assert data[r["offset"] : r["offset"] + r["length"]].decode(codecs[r["encoding"]]) == r["text"]
    assert {(r["text"], r["encoding"]) for r in got} >= {("plain one", "ascii"), ("wide text", "utf-16le"), ("über", "utf-8"), ("ends here", "ascii")}
    assert all(r["path"] == "0" for r in got)  # too short, empty, null and padding give nothing


def test_interleaved_fragments(spark):
    data = "ABCD".encode("utf-16-le")
    assert [r["encoding"] for r in extract.scan(sections_of(spark, data + b"\x00\x00"), extract.Extraction()).collect()] == ["utf-16le"]


def test_dedup_keeps_every_occurrence(spark):
    raw = extract.scan(sections_of(spark, b"same\x00 same \x00other\x00same\x00"), extract.Extraction())
    groups = dedup.deduplicate(raw).collect()
    assert sum(len(g["occurrences"]) for g in groups) == raw.count() == 4
    assert {g["canonical_text"]: len(g["occurrences"]) for g in groups} == {"same": 3, "other": 1}


def test_whole_pipeline(spark):
    files = spark.createDataFrame([("dir/a.bin", elf()), ("dir/bad", b"junk")], "path string, content binary")
    found = {r["text"]: r for r in pipeline.analyse(files).collect()}
    url = found["https://api.example.com/v1"]
    assert url["tags"] == ["url", "filepath"] and url["section"] == ".rodata" and elf()[url["offset"] :].startswith(b"https://")
    assert int(url["rva"]) == 0x400000 + url["offset"]
    assert found["printf"]["source"] == "ImportName" and "import" in found["printf"]["tags"]
    none = pipeline.analyse(files, config.merged(config.Config(), {"output": {"only": ["guid"]}}))
    assert none.count() == 0


def test_changes(spark):
    old, new = (spark.createDataFrame([(x,) for x in t], "text string") for t in ("ab", "bc"))
    assert sorted(map(tuple, select.changes(old, new).collect())) == [("a", "removed"), ("c", "added")]


def test_sinks(spark):
    rows = queries.found(spark, "/root/testdata/sf0.001", "urls")
    for r in sinks.json_lines(rows).limit(5).collect():
        assert list(json.loads(r["value"])) == ["text", "encoding", "offset", "rva", "section", "length", "tags", "score", "source"]
    rule = sinks.yara(rows, least=0).first()["value"]
    assert rule.startswith("rule ") and "any of them" in rule and "$url_1" in rule
    quoted = column(spark, sinks.yara_text(F.col("x"), F.lit("ascii")), ('a"b\\',), ("ü",))
    assert quoted == ['"a\\"b\\\\" ascii', "{ C3 BC }"]


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[extraction]\nmin_length = 7\n[output]\nonly = ["url"]\n')
    got = config.load(str(path), "security", {"GLYPHSIFT_MAX_RESULTS": "5"})
    assert (got.extraction.min_length, got.output.max_results, got.output.min_score) == (6, 5, 70)
    assert config.load(None, None, {}).extraction.min_length == 4
    assert extract.Extraction(min_length=10, max_length=5).warnings
    with pytest.raises(ValueError):
        config.merged(config.Config(), {"output": {"nonsense": 1}})
    with pytest.raises(ValueError):
        config.load(None, "nobody", {})


def test_demangle():
    for name, plain in queries.MANGLED:
        assert demangle.demangled(name) == plain
    assert demangle.demangled(None) is None


def test_files_stream_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.bin").write_bytes(elf())
    files = binaries.read_files(spark, str(tmp_path / "in"))
    assert files.count() == 1 and binaries.distinct_files(files, binaries.distinct_files(files)).count() == 0
    stream = arrivals.arriving(spark, str(tmp_path / "in"))
    arrivals.start(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("array_contains(tags, 'url')").count() == 1
    assert cli.main([str(tmp_path / "in" / "one.bin"), "--json", "--only", "url"], spark) == cli.OK
    assert json.loads(capsys.readouterr().out.strip())["text"] == "https://api.example.com/v1"
    assert cli.main([str(tmp_path / "missing")], spark) == cli.NOT_FOUND
    assert cli.main(["x", "--profile", "nobody"], spark) == cli.USAGE
    (tmp_path / "junk").write_bytes(b"junk junk junk")
    assert cli.main([str(tmp_path / "junk")], spark) == cli.UNSUPPORTED


def test_unsigned_addresses(spark):
    files = spark.createDataFrame([("h", elf64([(".rodata", 2, b"kernel text\0", 1)], high=0xFFFFFFFF80000000))], "path string, content binary")
    assert int(pipeline.analyse(files).first()["rva"]) > 1 << 63


def test_numbers_are_those_of_one_sort(spark):
    rows = [(i * 7 % 11, f"p{i % 5}", i % 13, f"t{i % 3}", "ascii") for i in range(400)]
    df = spark.createDataFrame(rows, "score int, path string, offset long, text string, encoding string")
    expected = sorted(rows, key=lambda r: (-r[0], *r[1:]))
    for parts, sample in ((1, 10), (7, 30), (64, 6400)):
        got = sorted(select.numbered(df, parts, sample).collect(), key=lambda r: r["place"])
        assert [tuple(r)[:5] for r in got] == expected and [r["place"] for r in got] == list(range(1, 401))
    assert select.numbered(df.limit(0)).isEmpty()


def test_interleaved_runs_by_brute_force(spark):
    import random

    draw = random.Random(5)
    bodies = [b"".join(draw.choice((b"a\0", b"\0b", b"cd", b"\n", b"efgh", b"x\0y\0z\0")) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(bodies)], "path string, content binary")
    how = dict(encodings=("ascii", "utf-16"), drop_padding=False)
    every = extract.scan(df, extract.Extraction(drop_interleaved=False, **how)).collect()
    left = {(r["path"], r["encoding"], r["offset"]) for r in extract.scan(df, extract.Extraction(**how)).collect()}
    wide = [r for r in every if r["encoding"] != "ascii"]
    hidden = {(r["path"], r["encoding"], r["offset"]) for r in every if r["encoding"] == "ascii" and any(w["path"] == r["path"] and w["offset"] < r["offset"] + r["length"] and r["offset"] < w["offset"] + w["length"] for w in wide)}
    assert hidden and left == {(r["path"], r["encoding"], r["offset"]) for r in every} - hidden


def test_settings_by_their_names_in_files(tmp_path):
    file = tmp_path / "own.toml"
    file.write_text('[ranking]\nsection_weight_multiplier = 2.0\n[ranking.section_weights]\nstring_data = 50\n[ranking.semantic_boosts]\nformat_string = 1\n[formats.elf]\ninclude_note_sections = true\n[formats.macho]\nprocess_fat_binaries = "x86_64"\n')
    got = config.load(str(file), environment={})
    assert got.ranking.section_weights["StringData"] == 50 and got.ranking.section_weights["Resources"] == 35
    assert got.ranking.semantic_boosts["fmt"] == 1 and got.ranking.section_weight_multiplier == 2.0
    assert got.formats == {"elf": {"notes": True}, "macho": {"fat": "x86_64"}}
    for wrong in ({"formats": {"elf": {"colour": 1}}}, {"formats": {"coff": {}}}, {"formats": {"macho": {"fat": "z80"}}}, {"ranking": {"section_weights": {"attic": 1}}}):
        with pytest.raises(ValueError):
            config.merged(config.Config(), wrong)
