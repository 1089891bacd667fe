import gzip
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from spectrel.sources import fasta, features, files, identifications, mzml, obo, store

MZML = """<?xml version="1.0"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml" id="x"><run id="run1"><spectrumList count="2" defaultDataProcessingRef="p">
<spectrum index="0" id="controllerType=0 scan=4" defaultArrayLength="2"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="1"/>
<scanList count="1"><scan><cvParam cvRef="MS" accession="MS:1000016" name="scan start time" value="0.5" unitAccession="UO:0000031"/></scan></scanList>
<binaryDataArrayList count="2">{a}</binaryDataArrayList></spectrum>
<spectrum index="1" id="controllerType=0 scan=5" defaultArrayLength="2"><cvParam cvRef="MS" accession="MS:1000511" name="ms level" value="2"/><cvParam cvRef="MS" accession="MS:1000285" name="" value="6.5e2"/><userParam name="note" value="a &amp; b" type="xsd:string"/>
<scanList count="1"><scan><cvParam cvRef="MS" accession="MS:1000016" name="" value="3" unitAccession="UO:0000010"/></scan></scanList>
<precursorList count="1"><precursor spectrumRef="controllerType=0 scan=4"><selectedIonList count="1"><selectedIon><cvParam accession="MS:1000744" name="" value="410.68"/><cvParam accession="MS:1000041" name="" value="2"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1000422" name="" value=""/></activation></precursor></precursorList>
<binaryDataArrayList count="2">{b}</binaryDataArrayList></spectrum></spectrumList></run></mzML>"""


def binary(values, kind, wide=True, packed=True):
    marks = "".join(f'<cvParam accession="{a}" name="" value=""/>' for a in ([mzml.BITS_64] if wide else []) + ([mzml.ZLIB] if packed else []) + [kind])
    return f"<binaryDataArray>{marks}<binary>{mzml.encode(values, wide, packed)}</binary></binaryDataArray>"


@pytest.fixture()
def run(tmp_path):
    a = binary([1.5, 2.5], "MS:1000514") + binary([10, 20], "MS:1000515", False, False)
    b = binary([3.25, 4.5], "MS:1000514", packed=False) + binary([5, 6], "MS:1000515")
    path = tmp_path / "run1.mzML"
    path.write_text(MZML.format(a=a, b=b))
    return path


def test_mzml(spark, run):
    t = mzml.read_run(spark, str(run))
    rows = {r["id"]: r for r in t["spectra"].collect()}
    assert rows["4"]["rt"] == 30 and rows["4"]["msnIdList"] == ["5"] and rows["4"]["specfile"] == "run1"
    five = rows["5"]
    assert (five["msLevel"], five["tic"], five["rt"], five["precursorId"], five["obsMz"], five["charge"]) == (2, 650.0, 3.0, "4", 410.68, 2)
    arrays = {r["id"]: (r["mz"], r["i"]) for r in t["arrays"].collect()}
    assert arrays == {"4": ([1.5, 2.5], [10, 20]), "5": ([3.25, 4.5], [5, 6])}


def test_mzml_gzip(spark, run):
    packed = run.with_suffix(".mzML.gz")
    with run.open("rb") as a, gzip.open(packed, "wb") as b:
        shutil.copyfileobj(a, b)
    run.unlink()
    assert mzml.read_run(spark, str(packed))["spectra"].count() == 2


def test_mzml_written_and_read(spark, run, tmp_path):
    t = mzml.read_run(spark, str(run))
    out = tmp_path / "out"
    out.mkdir()
    mzml.write_mzml(t["metadata"], t["arrays"], str(out)).collect()
    text = (out / "run1.mzML").read_text("ISO-8859-1")
    offset = int(text.split("scan=4\">")[-1].split("<")[0])
    assert text[offset:].startswith("<spectrum index=\"0\"")
    again = mzml.read_run(spark, str(out / "run1.mzML"))
    one, two = ([tuple(r) for r in x["spectra"].drop("ord").orderBy("id").collect()] for x in (t, again))
    assert one == two
    assert [tuple(r)[2:4] for r in t["arrays"].orderBy("id").collect()] == [tuple(r)[2:4] for r in again["arrays"].orderBy("id").collect()]


def test_mzml_with_products(spark, run, tmp_path):
    """Product ions' isolation windows come back from a written file, an empty one too."""
    product = '<productList count="2"><product><isolationWindow><cvParam accession="MS:1000827" name="" value="410.5"/><userParam name="note" value="x"/></isolationWindow></product><product/></productList>'
    text = run.read_text()
    run.write_text(text.replace("</precursorList>", "</precursorList>" + product))
    t = mzml.read_run(spark, str(run))
    (tmp_path / "out").mkdir()
    mzml.write_mzml(t["metadata"], t["arrays"], str(tmp_path / "out")).collect()
    of = lambda x: {r["id"]: r["productList"] for r in x["metadata"].select("id", "productList").collect()}
    again = mzml.read_run(spark, str(tmp_path / "out" / "run1.mzML"))
    assert len(of(t)["5"]) == 2 and of(t)["5"][0]["isolationWindow"][0]["value"] == "410.5" and of(again)["5"] == of(t)["5"] and not of(again)["4"]


@pytest.mark.parametrize("packed", [False, True])
def test_run_metadata_of_a_file_in_many_parts(spark, tmp_path, packed):
    """What is outside the lists stays as it is, whatever the number of splits; signs like > within it too."""
    head = '<?xml version="1.0"?>\n<indexedmzML><mzML id="x"><!-- a > b --><cvList count="1"><cv id="MS"/></cvList><run id="r"><spectrumList count="3000" defaultDataProcessingRef="p">'
    between = '</spectrumList>\n<chromatogramList count="1">'
    tail = '</chromatogramList></run></mzML><indexList count="1"></indexList><indexListOffset>77</indexListOffset></indexedmzML>'
    spectra = "".join(f'<spectrum index="{i}" id="scan={i}"><binary>{"QUJD" * 40}</binary></spectrum>' for i in range(3000))
    text = (head + spectra + "\n" + between + '<chromatogram id="TIC"/>' + tail).replace('<indexList count="1">', '<indexList count="1"><offset idRef="scan=1">9</offset>')
    path = tmp_path / ("many.mzML.gz" if packed else "many.mzML")
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    (tmp_path / "other.mzML").write_text("<mzML><run id='o'></run></mzML>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r["specfile"]: r["xml"] for r in mzml.read_run_metadata(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"many": head + between + tail, "other": "<mzML><run id='o'></run></mzML>\n"}


def test_mzml_with_chromatograms_and_metadata(spark, run, tmp_path):
    about = '<cvList count="1"><cv id="MS"/></cvList><softwareList count="1"><software id="maker"/></softwareList>'
    chromatogram = '<chromatogramList count="1" defaultDataProcessingRef="q"><chromatogram index="0" id="TIC" defaultArrayLength="2"><cvParam accession="MS:1000235" name="" value=""/><binaryDataArrayList count="2">{}</binaryDataArrayList></chromatogram></chromatogramList>'
    text = run.read_text().replace('<run id="run1">', about + '<run id="run1" startTimeStamp="2024">').replace("</run>", chromatogram.format(binary([0.5, 1.0], "MS:1000595") + binary([7, 8], "MS:1000515")) + "</run>")
    run.write_text(text)
    t = mzml.read_run(spark, str(run))
    (tmp_path / "out").mkdir()
    done = mzml.write_mzml(t["metadata"], t["arrays"], str(tmp_path / "out"), ids=["5", "4"], chromatograms=t["chromatograms"], runs=t["runs"]).collect()
    assert [(r["specfile"], r["spectra"]) for r in done] == [("run1", 2)] and [x.name for x in (tmp_path / "out").iterdir()] == ["run1.mzML"]
    text = (tmp_path / "out" / "run1.mzML").read_text("ISO-8859-1")
    assert about in text and 'startTimeStamp="2024"' in text and text.index("scan=5") < text.index('id="controllerType=0 scan=4"') and '<chromatogramList count="1" defaultDataProcessingRef="q">' in text
    assert text[int(text.split('idRef="TIC">')[1].split("<")[0]) :].startswith("<chromatogram index")
    assert hashlib.sha1(text.split("<fileChecksum>")[0].encode("ISO-8859-1") + b"<fileChecksum>").hexdigest() in text
    again = mzml.read_run(spark, str(tmp_path / "out" / "run1.mzML"))
    plain = lambda x: [(r["id"], r["arrays"]) for r in x["chromatograms"].collect()]
    assert plain(again) == plain(t) and len(plain(t)) == 1


def test_percolator(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("PSMId\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\nrun_7_2_1\t3.5\t0.001\t0.01\tK.AAC[UNIMOD:4]K.R\tP1\tP2\nrun_7_2_2\t1.5\t0.001\t0.01\tK.AAK.R\tP1\n")
    rows = identifications.read_percolator(spark, str(path), "run", "comet").orderBy("rank").collect()
    assert [(r["id"], r["peptide"], r["sequence"], r["rank"], r["isValid"]) for r in rows] == [("7", "AAC[u:4]K", "AACK", 1, True), ("7", "AAK", "AAK", 2, False)]


def test_mzid(spark, tmp_path):
    path = tmp_path / "r.mzid"
    path.write_text(
        """<MzIdentML><SequenceCollection><Peptide id="p1"><PeptideSequence>AMK</PeptideSequence><Modification location="2"><cvParam accession="UNIMOD:35" name="Oxidation" value=""/></Modification><Modification location="0"><cvParam name="Foo" accession="x" value=""/></Modification></Peptide></SequenceCollection>
<SpectrumIdentificationResult spectrumID="index=1" id="r1"><SpectrumIdentificationItem id="i1" chargeState="2" rank="1" passThreshold="true" peptide_ref="p1"><cvParam accession="a" name="MS-GF:EValue" value="0.001"/><cvParam accession="b" name="MS-GF:SpecEValue" value="1e-9"/></SpectrumIdentificationItem><cvParam accession="c" name="scan number(s)" value="17"/></SpectrumIdentificationResult></MzIdentML>"""
    )
    r = identifications.read_mzid(spark, str(path)).first()
    assert (r["specfile"], r["id"], r["peptide"], r["charge"], round(r["score"], 6), r["isValid"]) == ("r", "17", "[Foo]AM[u:35]K", 2, 3.0, True)


def test_features(spark, tmp_path):
    a = tmp_path / "x.featureXML"
    a.write_text('<featureMap><feature id="f1"><position dim="0">100.5</position><position dim="1">500.25</position><intensity>1e6</intensity><overallquality>0.5</overallquality><charge>2</charge><convexhull nr="0"><pt x="95" y="500.2"/><pt x="110" y="500.3"/></convexhull></feature></featureMap>')
    r = features.read_features(spark, str(a), "run").first()
    assert (r["id"], r["rt"], r["mz"], r["rtLow"], r["rtHigh"], r["rtArea"], r["charge"]) == ("f1", 100.5, 500.25, 95, 110, 15, 2)
    b = tmp_path / "x.features.tsv"
    b.write_text("mz\tcharge\trtStart\trtApex\trtEnd\tfwhm\tnIsotopes\tnScans\tintensityApex\tintensitySum\n500.5\t2\t1\t1.5\t2\t0.1\t3\t9\t5\t50\n600.5\t3\t1\t1.5\t2\t0.1\t3\t9\t5\t60\n")
    rows = features.read_features(spark, str(b), "run").orderBy("ord").collect()
    assert [(r["id"], r["rt"], r["rtLow"], r["intensity"]) for r in rows] == [("0", 90, 60, 50), ("1", 90, 60, 60)]
    with pytest.raises(ValueError):
        features.read_features(spark, "x.csv", "run")


FASTA = """>sp|Q7A|WHEEL_TOY First invented entry OS=Machina ludens GN=whl PE=2 SV=3
MKTAYIAKQR
QISFVKSHFS
RQ  
LEE*
>sp|Q7B|AXLE_TOY Second invented entry OS=Machina ludens GN=axl PE=1 SV=1
MAGSPKLLR
>sp|Q7C|GONE_TOY an entry without a sequence
"""


def test_fasta(spark, tmp_path):
    path = tmp_path / "p.fasta"
    path.write_text(FASTA)
    rows = {r["id"]: r for r in fasta.proteins(fasta.read_fasta(spark, str(path))).collect()}
    assert set(rows) == {"Q7A", "Q7B"} and rows["Q7A"]["sequence"] == "MKTAYIAKQRQISFVKSHFSRQLEE"
    info = rows["Q7A"]["headerInfo"]
    assert (info["GN"], info["OS"], info["PE"], info["db"], info["entry"], info["gene_id"], info["taxon"]) == ("whl", "Machina ludens", "2", "sp", "WHEEL_TOY", "WHEEL", "TOY")
    bad = tmp_path / "bad.fasta"
    bad.write_text("MKTA\nGGG\n")
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, str(bad))


def test_fasta_headers(spark):
    heads = spark.createDataFrame([("tr|K9|x y",), ("K9 y",), ("K9|y",), ("K9",)], "h string")
    assert {r["m"]["id"] for r in heads.select(fasta.accession_header(F.col("h")).alias("m")).collect()} == {"K9"}
    sgd = spark.createDataFrame([('YTX7 AXL1 SGDID:S9, Chr IV from 5-70, "Turns the wheel"',)], "h string").select(fasta.sgd_header(F.col("h")).alias("m")).first()["m"]
    assert sgd == {"id": "YTX7", "name": "AXL1", "description": '"Turns the wheel"'}
    records = spark.createDataFrame([("[decoy]sp|A|B_C d", "AAA"), ("odd header", "CCC")], "header string, sequence string")
    assert {r["id"] for r in fasta.proteins(records, force_id=True).collect()} == {"[decoy]A", "odd header"}
    with pytest.raises(Exception, match="unreadable"):
        fasta.proteins(records).collect()


def test_obo(spark, tmp_path):
    path = tmp_path / "u.obo"
    path.write_text("format-version: 1.2\n\n[Term]\nid: UO:0000010\nname: second\nis_a: a\nis_a: b\n\n[Term]\nid: UO:0000031\nname: old\nis_obsolete: true\n\n[Term]\nid: UO:0000031\nname: minute\n\n[Typedef]\nid: part_of\n")
    rows = {r["id"]: (r["name"], r["isObsolete"], r["attributes"].get("is_a")) for r in obo.read_obo(spark, str(path)).collect()}
    assert rows == {"UO:0000010": ("second", False, "b"), "UO:0000031": ("minute", False, None)}


def test_store_replaces_runs(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "specfile string, x int")
    store.save(t, str(tmp_path), "t")
    store.save(spark.createDataFrame([("b", 3)], "specfile string, x int"), str(tmp_path), "t")
    assert sorted((r["specfile"], r["x"]) for r in store.load(spark, str(tmp_path), "t").collect()) == [("a", 1), ("b", 3)]
    assert store.load(spark, str(tmp_path), "t", ["a"]).count() == 1


def test_store_keeps_whole_tables_whole(spark, tmp_path):
    """A reader has the version that held when it came; a failed job changes nothing; old versions go."""
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        store.load_whole(spark, root, "t")
    store.save_whole(spark.range(3), root, "t")
    early = store.load_whole(spark, root, "t")
    store.save_whole(early.union(spark.range(7, 9)), root, "t")
    assert early.count() == 3 and sorted(r["id"] for r in store.load_whole(spark, root, "t").collect()) == [0, 1, 2, 7, 8]
    with pytest.raises(Exception):
        store.save_whole(spark.range(2).select(F.raise_error(F.lit("stopped")).alias("id")), root, "t")
    assert store.load_whole(spark, root, "t").count() == 5
    store.save_whole(spark.range(1), root, "t")
    assert store.load_whole(spark, root, "t").count() == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) <= 3


def test_store_of_all_tables_of_a_run(spark, tmp_path):
    tables = {"runs": spark.createDataFrame([("a", 1), ("b", 2)], "specfile string, x int"), "spectra": spark.createDataFrame([("a", "s1"), ("b", "s2")], "specfile string, id string")}
    store.save_run(tables, str(tmp_path), ("runs", "spectra"))
    got = store.load_run(spark, str(tmp_path), ("runs", "spectra"), ["b"])
    assert [r["id"] for r in got["spectra"].collect()] == ["s2"] and got["runs"].count() == 1


def test_files(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "run1.mzML").write_text("")
    (tmp_path / "run1.tsv").write_text("")
    assert files.find_file("run1", "mzml", str(tmp_path)).endswith("run1.mzML")
    assert files.find_file("run1", "mzml", str(tmp_path), False) is None
    assert files.filetypes("run1", str(tmp_path)) == {"tsv"} and len(files.matching_files("run1", str(tmp_path))) == 2
