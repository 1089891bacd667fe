"""mzML: spectra, chromatograms and run metadata by Spark's XML source (which splits files by element), and a writer."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from functools import reduce
from pathlib import Path
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARAMS = "cvParam:array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>,userParam:array<struct<_name:string,_value:string,_unitAccession:string,_type:string>>,referenceableParamGroupRef:array<struct<_ref:string>>"
_BINARY = f"binaryDataArrayList:struct<binaryDataArray:array<struct<_dataProcessingRef:string,{_PARAMS},binary:string>>>"
_TOP = _PARAMS.replace("cvParam:", "cvParam ", 1).replace(",userParam:", ", userParam ", 1).replace(",referenceableParamGroupRef:", ", referenceableParamGroupRef ", 1)
SPECTRUM = (
    f"_id string, _index string, _defaultArrayLength int, {_TOP}, scanList struct<{_PARAMS},scan:array<struct<{_PARAMS},scanWindowList:struct<scanWindow:array<struct<{_PARAMS}>>>>>>, "
    f"precursorList struct<precursor:array<struct<_spectrumRef:string,activation:struct<{_PARAMS}>,isolationWindow:struct<{_PARAMS}>,selectedIonList:struct<selectedIon:array<struct<{_PARAMS}>>>>>>, "
    f"productList struct<product:array<struct<isolationWindow:struct<{_PARAMS}>>>>, {_BINARY.replace(':', ' ', 1)}"
)
CHROMATOGRAM = f"_id string, _defaultArrayLength int, _dataProcessingRef string, {_TOP}, {_BINARY.replace(':', ' ', 1)}"

# Accessions of the values that spectra are described by, and of binary array kinds.
MS_LEVEL, TIC, BASE_PEAK_MZ, BASE_PEAK_I = "MS:1000511", "MS:1000285", "MS:1000504", "MS:1000505"
SCAN_TIME, INJECTION_TIME, MINUTE = "MS:1000016", "MS:1000927", "UO:0000031"
SELECTED_MZ, PEAK_I, CHARGE = "MS:1000744", "MS:1000042", "MS:1000041"
BITS_64, ZLIB = "MS:1000523", "MS:1000574"
ARRAY_KINDS = {"MS:1000514": "mz", "MS:1000515": "i", "MS:1000516": "z", "MS:1000517": "sn", "MS:1000595": "rt", "MS:1000617": "lambda", "MS:1000786": "non-standard", "MS:1000820": "flowrate", "MS:1000821": "pressure", "MS:1000822": "temperature"}


def params(element: Column) -> Column:
    """array<PARAM> of an element's cvParam, userParam and group references, in this order."""
    null = F.lit(None).cast("string")
    one = lambda kind, name, value, unit, type_: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), unit.alias("unit"), type_.alias("type"))
    none = F.array().cast("array<struct<kind:string,name:string,value:string,unit:string,type:string>>")
    cv = F.transform(element["cvParam"], lambda p: one("cv", p["_accession"], p["_value"], p["_unitAccession"], null))
    user = F.transform(element["userParam"], lambda p: one("user", p["_name"], p["_value"], p["_unitAccession"], p["_type"]))
    ref = F.transform(element["referenceableParamGroupRef"], lambda p: one("ref", p["_ref"], null, null, null))
    return F.concat(*[F.coalesce(x, none) for x in (cv, user, ref)])


def param(found: Column, name: str) -> Column:
    """The first parameter of an accession or name, else null."""
    return F.try_element_at(F.filter(found, lambda p: p["name"] == name), F.lit(1))


def decode(binary: bytes | str | None, wide: bool, packed: bool) -> np.ndarray:
    raw = base64.b64decode("".join((binary if isinstance(binary, str) else (binary or b"").decode()).split()))
    if packed and raw:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, "<f8" if wide else "<f4").astype(float)


def encode(values, wide: bool = True, packed: bool = True) -> str:
    raw = np.asarray(values, "<f8" if wide else "<f4").tobytes()
    return base64.b64encode(zlib.compress(raw) if packed else raw).decode()


def _decoded(binary: Column, wide: Column, packed: Column) -> Column:
    @F.pandas_udf("array<double>")
    def one(binary: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([decode(b, w, p) for b, w, p in zip(binary, wide, packed)])

    return one(binary, wide, packed)


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    found = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    name = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1), r"(?i)\.(mzml|xml)(\.gz)?$", "")
    return found.withColumn("specfile", name)


def scan_number(native: Column) -> Column:
    return F.regexp_extract(native, r"scan=(\S+)", 1)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all spectra with their run. Their native ids must hold scan=."""
    return _read(spark, path, "spectrum", SPECTRUM).withColumn("id", scan_number(F.col("_id"))).withColumn("ord", F.coalesce(F.col("_index").cast("long"), F.monotonically_increasing_id()))


def spectrum_metadata(spectra: DataFrame) -> DataFrame:
    each = lambda xs, f: F.coalesce(F.transform(xs, f), F.array())
    window = lambda w: params(w)
    return spectra.select(
        "specfile", "id", "ord",
        F.create_map(F.lit("id"), "_id", F.lit("index"), "_index", F.lit("defaultArrayLength"), F.col("_defaultArrayLength").cast("string")).alias("attributes"),
        params_of_row().alias("params"),
        params(F.col("scanList")).alias("scanListParams"),
        F.transform("scanList.scan", lambda s: F.struct(each(s["scanWindowList"]["scanWindow"], window).alias("scanWindowList"), params(s).alias("params"))).alias("scanList"),
        F.transform("precursorList.precursor", lambda p: F.struct(p["_spectrumRef"].alias("spectrumRef"), params(p["activation"]).alias("activation"), params(p["isolationWindow"]).alias("isolationWindow"), each(p["selectedIonList"]["selectedIon"], window).alias("selectedIonList"))).alias("precursorList"),
        F.transform("productList.product", lambda p: F.struct(params(p["isolationWindow"]).alias("isolationWindow"))).alias("productList"),
    )


def params_of_row() -> Column:
    return params({k: F.col(k) for k in ("cvParam", "userParam", "referenceableParamGroupRef")})  # type: ignore[arg-type]


def spectrum_table(metadata: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each spectrum with its usual attributes, and its fragment scans (msnIdList) where it has any."""
    number = lambda found, name, kind="double": param(found, name)["value"].cast(kind)
    scan = F.get("scanList", F.lit(0))["params"]
    time = param(scan, SCAN_TIME)
    precursor = F.get("precursorList", F.lit(0))
    ion = F.get(precursor["selectedIonList"], F.lit(0))
    rows = metadata.select(
        "specfile", "id", "ord", F.lit(None).cast("boolean").alias("isValid"), number(F.col("params"), MS_LEVEL, "int").alias("msLevel"), number(F.col("params"), TIC).alias("tic"), number(F.col("params"), BASE_PEAK_MZ).alias("basepeakMz"),
        number(F.col("params"), BASE_PEAK_I).alias("basepeakI"), (time["value"].cast("double") * F.when(time["unit"] == MINUTE, 60).otherwise(1)).alias("rt"), number(scan, INJECTION_TIME).alias("iit"),
        F.when(precursor["spectrumRef"].contains("scan="), scan_number(precursor["spectrumRef"])).otherwise(precursor["spectrumRef"]).alias("precursorId"),
        number(ion, SELECTED_MZ).alias("obsMz"), number(ion, PEAK_I).alias("i"), number(ion, CHARGE, "int").alias("charge"), *[c.alias(n) for n, c in (extra or {}).items()],
    )
    children = rows.where("precursorId is not null").groupBy("specfile", F.col("precursorId").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("msnIdList"))
    return rows.join(children, ["specfile", "id"], "left")


def arrays(elements: DataFrame) -> DataFrame:
    """(specfile, id, arrays map<kind, values>) of spectra or chromatograms."""
    kinds = F.create_map(*[F.lit(x) for pair in ARRAY_KINDS.items() for x in pair])
    one = elements.select("specfile", "id", F.explode("binaryDataArrayList.binaryDataArray").alias("a")).select("specfile", "id", params(F.col("a")).alias("p"), F.coalesce("a.binary", F.lit("")).alias("binary"))
    kind = F.element_at(F.filter(F.transform("p", lambda p: F.try_element_at(kinds, p["name"])), lambda x: x.isNotNull()), 1)
    has = lambda name: F.exists("p", lambda p: p["name"] == name)
    decoded = one.select("specfile", "id", kind.alias("kind"), _decoded(F.col("binary"), has(BITS_64), has(ZLIB)).alias("v"))
    return decoded.groupBy("specfile", "id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias("arrays"))


def spectrum_arrays(spectra: DataFrame) -> DataFrame:
    found = arrays(spectra)
    return found.select("specfile", "id", F.try_element_at("arrays", F.lit("mz")).alias("mz"), F.try_element_at("arrays", F.lit("i")).alias("i"), F.map_filter("arrays", lambda k, v: ~k.isin("mz", "i")).alias("extra"))


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    elements = _read(spark, path, "chromatogram", CHROMATOGRAM).withColumn("id", F.col("_id"))
    described = elements.select("specfile", "id", F.col("_dataProcessingRef").alias("dataProcessingRef"), params_of_row().alias("params"))
    return described.join(arrays(elements), ["specfile", "id"], "left")


#: Elements whose content isn't metadata: it grows with the spectra.
CONTENTS = ("spectrumList", "chromatogramList", "indexList")


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(specfile, xml): the file without what its lists of spectra, chromatograms and offsets hold.

    Files (gzip too) are read as a stream of tags: a row ends at each ">", so no file is ever held as a whole, and only the
    tags before, between and after the lists are put together again, by their places in the file.
    """
    name = F.regexp_replace(F.regexp_extract("_metadata.file_name", r"([^/]+)$", 1), r"(?i)\.(mzml|xml)(\.gz)?$", "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    tags = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("file"), name.alias("specfile"), place.alias("at"), "value")
    value, at = F.col("value"), F.col("at")
    bounds = []
    for x in CONTENTS:
        bounds.append(F.min(F.when(value.contains(f"<{x}") & value.rlike(rf"<{x}(?=\s|$)[^<]*$"), at)).alias(f"open_{x}"))
        bounds.append(F.max(F.when(value.contains(f"</{x}") & value.rlike(rf"</{x}\s*$"), at)).alias(f"close_{x}"))
    # one row a file, of whose names the driver has a list anyway
    inside = tags.join(F.broadcast(tags.groupBy("file").agg(*bounds)), "file")
    shown = value
    for x in CONTENTS:
        inside = inside.where(F.coalesce((at <= F.col(f"open_{x}")) | (at >= F.col(f"close_{x}")), F.lit(True)))
        shown = F.when(at == F.col(f"close_{x}"), F.lit(f"</{x}")).otherwise(shown)
    parts = inside.select("file", "specfile", F.struct("at", shown.alias("value")).alias("part")).groupBy("file", "specfile").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    texts = F.transform("parts", lambda p: p["value"])
    # what follows the last ">" is white space; a file that ends with it has no such row
    ends = F.when(F.element_at(texts, -1).rlike(r"^\s*$"), F.lit("")).otherwise(F.lit(">"))
    return parts.select("specfile", F.concat(F.array_join(texts, ">"), ends).alias("xml"))


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the mzML files of a path: metadata, spectra, arrays, chromatograms, runs."""
    elements = read_spectra(spark, path)
    metadata = spectrum_metadata(elements)
    return {"metadata": metadata, "spectra": spectrum_table(metadata), "arrays": spectrum_arrays(elements), "chromatograms": read_chromatograms(spark, path), "runs": read_run_metadata(spark, path)}


# ---------------------------------------------------------------- writer


def _xml_params(found, pad: str, names: dict[str, str]) -> str:
    out = []
    for p in found or []:
        unit = f' unitCvRef={quoteattr(p["unit"].split(":")[0])} unitAccession={quoteattr(p["unit"])} unitName={quoteattr(names.get(p["unit"], ""))}' if p["unit"] else ""
        if p["kind"] == "cv":
            out.append(f'{pad}<cvParam cvRef={quoteattr(p["name"].split(":")[0])} accession={quoteattr(p["name"])} name={quoteattr(names.get(p["name"], ""))} value={quoteattr(p["value"] or "")}{unit}/>')
        elif p["kind"] == "user":
            kind = f' type={quoteattr(p["type"])}' if p["type"] else ""
            value = f' value={quoteattr(p["value"])}' if p["value"] is not None else ""
            out.append(f'{pad}<userParam name={quoteattr(p["name"])}{kind}{value}{unit}/>')
        else:
            out.append(f'{pad}<referenceableParamGroupRef ref={quoteattr(p["name"])}/>')
    return "".join(x + "\n" for x in out)


def spectrum_xml(index: int, row: dict, values: dict[str, list], names: dict[str, str]) -> str:
    """A spectrum element. Its arrays must be of one length."""
    sizes = {len(v) for v in values.values()}
    if len(sizes) > 1:
        raise ValueError(f"arrays of different lengths in spectrum {row['id']}")
    p = lambda found, n: _xml_params(found, "  " * n, names)
    out = [f'<spectrum index="{index}" id={quoteattr(row["attributes"]["id"])} defaultArrayLength="{max(sizes, default=0)}">\n', p(row["params"], 1)]
    if row["scanList"] is not None:
        out.append(f'  <scanList count="{len(row["scanList"])}">\n{p(row["scanListParams"], 2)}')
        for s in row["scanList"]:
            windows = "".join(f"        <scanWindow>\n{p(w, 5)}        </scanWindow>\n" for w in s["scanWindowList"] or [])
            inner = f'      <scanWindowList count="{len(s["scanWindowList"])}">\n{windows}      </scanWindowList>\n' if windows else ""
            out.append(f'    <scan>\n{p(s["params"], 3)}{inner}    </scan>\n')
        out.append("  </scanList>\n")
    if row["precursorList"]:
        out.append(f'  <precursorList count="{len(row["precursorList"])}">\n')
        for q in row["precursorList"]:
            ref = f' spectrumRef={quoteattr(q["spectrumRef"])}' if q["spectrumRef"] else ""
            ions = "".join(f"        <selectedIon>\n{p(i, 5)}        </selectedIon>\n" for i in q["selectedIonList"] or [])
            isolation = f'      <isolationWindow>\n{p(q["isolationWindow"], 4)}      </isolationWindow>\n' if q["isolationWindow"] else ""
            count = len(q["selectedIonList"] or [])
            out.append(f'    <precursor{ref}>\n{isolation}      <selectedIonList count="{count}">\n{ions}      </selectedIonList>\n      <activation>\n{p(q["activation"], 4)}      </activation>\n    </precursor>\n')
        out.append("  </precursorList>\n")
    if row["productList"]:
        isolated = [f'      <isolationWindow>\n{p(q["isolationWindow"], 4)}      </isolationWindow>\n' if q["isolationWindow"] else "" for q in row["productList"]]
        products = "".join(f"    <product>\n{x}    </product>\n" for x in isolated)
        out.append(f'  <productList count="{len(isolated)}">\n{products}  </productList>\n')
    out.append(_xml_arrays(values) + "</spectrum>\n")
    return "".join(out)


def _xml_arrays(values: dict[str, list]) -> str:
    kinds = {v: k for k, v in ARRAY_KINDS.items()}
    out = [f'  <binaryDataArrayList count="{len(values)}">\n']
    for name, v in values.items():
        text = encode(v)
        accessions = "".join(f'      <cvParam cvRef="MS" accession="{a}" name="" value=""/>\n' for a in (BITS_64, ZLIB, kinds.get(name, "MS:1000786")))
        out.append(f'    <binaryDataArray encodedLength="{len(text)}">\n{accessions}      <binary>{text}</binary>\n    </binaryDataArray>\n')
    return "".join(out) + "  </binaryDataArrayList>\n"


def chromatogram_xml(index: int, row: dict, values: dict[str, list], names: dict[str, str]) -> str:
    size = max((len(v) for v in values.values()), default=0)
    ref = f' dataProcessingRef={quoteattr(row["dataProcessingRef"])}' if row.get("dataProcessingRef") else ""
    return f'<chromatogram index="{index}" id={quoteattr(row["id"])} defaultArrayLength="{size}"{ref}>\n' + _xml_params(row["params"], "  ", names) + _xml_arrays(values) + "</chromatogram>\n"


_HEAD, _SPECTRA, _CHROMATOGRAMS = 0, 1, 2
_LISTS = re.compile(r"\s*<(spectrum|chromatogram)List\b([^>]*)>")


def _elements(rows: DataFrame, section: int, names: dict[str, str]) -> DataFrame:
    """(specfile, section, n, id, text) of rows (specfile, n, j: JSON of an element with its arrays)."""

    def render(batches):
        import json

        for batch in batches:
            out = []
            for specfile, n, j in zip(batch["specfile"], batch["n"], batch["j"]):
                row = json.loads(j)
                values = {k: v for k, v in (row.pop("arrays", None) or {}).items() if v is not None}
                if section == _SPECTRA:
                    for key in ("params", "scanListParams", "scanList", "precursorList", "productList"):
                        row.setdefault(key, None)
                    out.append((specfile, section, n, row["attributes"]["id"], spectrum_xml(n, _filled(row), values, names)))
                else:
                    for p in row.setdefault("params", None) or []:
                        _fill(p)
                    out.append((specfile, section, n, row["id"], chromatogram_xml(n, row, values, names)))
            yield pd.DataFrame(out, columns=["specfile", "section", "n", "id", "text"])

    return rows.mapInPandas(render, "specfile string, section int, n long, id string, text string")


def write_mzml(metadata: DataFrame, arrays_: DataFrame, folder: str, ids: list[str] | None = None, index: bool = True, names: dict[str, str] | None = None, chromatograms: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Write each run to an (indexed) mzML file in a folder that all executors share; returns (specfile, path, spectra).

    Spectra come in their order in the source, or in that of ``ids``; chromatograms follow. ``runs`` (specfile, xml) gives
    what a file says about itself: its lists of vocabularies, files, software, instruments and processing. Elements become
    text in parallel; offsets and the checksum make a file sequential, so its text then streams through one task. A file is
    written under a name of the task's attempt and renamed, so a lost task leaves nothing half done.
    """
    known = names or {}
    own = metadata if ids is None else metadata.where(F.col("id").isin(ids))
    order = F.col("ord") if ids is None else F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))
    n = (F.row_number().over(Window.partitionBy("specfile").orderBy("o", "id")) - 1).cast("long").alias("n")
    numbered = own.select("specfile", "id", order.alias("o")).select("specfile", "id", n)
    values = arrays_.select("specfile", "id", F.map_concat(F.create_map(F.lit("mz"), "mz", F.lit("i"), "i"), "extra").alias("arrays"))
    rows = own.join(values, ["specfile", "id"]).join(numbered, ["specfile", "id"])
    parts = [_elements(rows.select("specfile", "n", F.to_json(F.struct("id", "attributes", "params", "scanListParams", "scanList", "precursorList", "productList", "arrays")).alias("j")), _SPECTRA, known)]
    counts = rows.groupBy("specfile").agg(F.count("*").alias("spectra"))
    if chromatograms is not None:
        last = chromatograms.select("specfile", (F.row_number().over(Window.partitionBy("specfile").orderBy("id")) - 1).cast("long").alias("n"), F.to_json(F.struct("id", "dataProcessingRef", "params", "arrays")).alias("j"))
        parts.append(_elements(last, _CHROMATOGRAMS, known))
        counts = counts.join(chromatograms.groupBy("specfile").agg(F.count("*").alias("chromatograms")), "specfile", "full")
    else:
        counts = counts.withColumn("chromatograms", F.lit(None).cast("long"))
    heads = counts.join(runs.select("specfile", "xml"), "specfile", "left") if runs is not None else counts.withColumn("xml", F.lit(None).cast("string"))
    sizes = F.concat_ws(" ", F.coalesce("spectra", F.lit(0)), F.coalesce("chromatograms", F.lit(0)))
    parts.append(heads.select("specfile", F.lit(_HEAD).alias("section"), F.lit(0).cast("long").alias("n"), sizes.alias("id"), F.coalesce("xml", F.lit("")).alias("text")))
    everything = reduce(DataFrame.unionByName, parts)

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        file = None
        for batch in batches:
            for specfile, section, _, id_, text in zip(*(batch[c] for c in ("specfile", "section", "n", "id", "text"))):
                if section == _HEAD:
                    if file is not None:
                        yield file.end()
                    file = _File(Path(folder), specfile, attempt, index, text, *map(int, id_.split()))
                else:
                    file.add(section, id_, text)
        if file is not None:
            yield file.end()

    dealt = everything.repartition("specfile").sortWithinPartitions("specfile", "section", "n")
    return dealt.mapInPandas(write, "specfile string, path string, spectra long")


class _File:
    """A run's file while it is written."""

    def __init__(self, folder: Path, specfile: str, attempt: int, index: bool, xml: str, spectra: int, chromatograms: int):
        self.specfile, self.index, self.sizes = specfile, index, {_SPECTRA: spectra, _CHROMATOGRAMS: chromatograms}
        self.target = folder / f"{specfile}.mzML"
        self.part = folder / f"{specfile}.part-{attempt}"
        self.out, self.digest, self.at = self.part.open("wb"), hashlib.sha1(), 0
        self.offsets: dict[int, list[tuple[int, str]]] = {_SPECTRA: [], _CHROMATOGRAMS: []}
        self.section = _HEAD
        self.attributes = {m.group(1): re.sub(r'\s*count="[^"]*"', "", m.group(2)).rstrip("/ ") for m in _LISTS.finditer(xml)}
        self.put('<?xml version="1.0" encoding="ISO-8859-1"?>\n')
        self.put('<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">\n' if index else "")
        at = xml.find("<mzML")
        first = _LISTS.search(xml)
        if at >= 0 and first:
            self.put(xml[at : first.start()] + "\n")
        else:
            self.put(f'<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0" id={quoteattr(specfile)}>\n<run id={quoteattr(specfile)}>\n')

    def put(self, text: str) -> None:
        data = text.encode("ISO-8859-1", "xmlcharrefreplace")
        self.out.write(data)
        self.digest.update(data)
        self.at += len(data)

    def turn(self, section: int) -> None:
        """End the list that is open, and open that of the next section."""
        names = {_SPECTRA: "spectrum", _CHROMATOGRAMS: "chromatogram"}
        if self.section:
            self.put(f"</{names[self.section]}List>\n")
        self.section = section
        if section:
            attributes = self.attributes.get(names[section]) or ' defaultDataProcessingRef="spectrel"'
            self.put(f'<{names[section]}List count="{self.sizes[section]}"{attributes}>\n')

    def add(self, section: int, id_: str, text: str) -> None:
        if section != self.section:
            self.turn(section)
        self.offsets[section].append((self.at, id_))
        self.put(text)

    def end(self) -> pd.DataFrame:
        self.turn(_HEAD)
        self.put("</run>\n</mzML>\n")
        if self.index:
            start = self.at
            lists = [(name, self.offsets[s]) for s, name in ((_SPECTRA, "spectrum"), (_CHROMATOGRAMS, "chromatogram")) if self.offsets[s]]
            self.put(f'<indexList count="{len(lists)}">\n')
            for name, offsets in lists:
                self.put(f'<index name="{name}">\n')
                for at, id_ in offsets:
                    self.put(f"<offset idRef={quoteattr(id_)}>{at}</offset>\n")
                self.put("</index>\n")
            self.put(f"</indexList>\n<indexListOffset>{start}</indexListOffset>\n<fileChecksum>")
            self.put(self.digest.hexdigest())
            self.put("</fileChecksum>\n</indexedmzML>\n")
        self.out.close()
        self.part.rename(self.target)
        return pd.DataFrame({"specfile": [self.specfile], "path": [str(self.target)], "spectra": [self.sizes[_SPECTRA]]})


def _filled(row: dict) -> dict:
    """JSON leaves null fields out; put them back."""
    for p in [*(row["params"] or []), *(row["scanListParams"] or [])]:
        _fill(p)
    for s in row["scanList"] or []:
        s.setdefault("scanWindowList", None)
        for group in [s.get("params") or [], *(s["scanWindowList"] or [])]:
            for p in group:
                _fill(p)
    for q in row["productList"] or []:
        for p in q.setdefault("isolationWindow", None) or []:
            _fill(p)
    for q in row["precursorList"] or []:
        for key in ("spectrumRef", "activation", "isolationWindow", "selectedIonList"):
            q.setdefault(key, None)
        for group in [q["activation"] or [], q["isolationWindow"] or [], *(q["selectedIonList"] or [])]:
            for p in group:
                _fill(p)
    return row


def _fill(p: dict) -> None:
    for key in ("value", "unit", "type"):
        p.setdefault(key, None)
