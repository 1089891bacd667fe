"""Schemas of the engine's tables. Tables of runs are partitioned by ``specfile``; ``ord`` is the order in the source."""

PARAM = "struct<kind:string,name:string,value:string,unit:string,type:string>"
SCAN = f"struct<scanWindowList:array<array<{PARAM}>>,params:array<{PARAM}>>"
PRODUCT = f"struct<isolationWindow:array<{PARAM}>>"
PRECURSOR = f"struct<spectrumRef:string,activation:array<{PARAM}>,isolationWindow:array<{PARAM}>,selectedIonList:array<array<{PARAM}>>>"
ARRAY_INFO = f"map<string,struct<dataProcessingRef:string,params:array<{PARAM}>>>"

RUNS = "specfile string, path string, status map<string,boolean>"
SPECTRA = (
    "specfile string, id string, ord long, isValid boolean, msLevel int, tic double, basepeakMz double, basepeakI double, rt double, iit double, precursorId string, obsMz double, i double, charge int, msnIdList array<string>"
)
SPECTRUM_ARRAYS = f"specfile string, id string, mz array<double>, i array<double>, extra map<string,array<double>>, arrayInfo {ARRAY_INFO}"
SPECTRUM_METADATA = (
    f"specfile string, id string, attributes map<string,string>, params array<{PARAM}>, scanListParams array<{PARAM}>, scanList array<{SCAN}>, precursorList array<{PRECURSOR}>, productList array<{PRODUCT}>"
)
CHROMATOGRAMS = f"specfile string, id string, dataProcessingRef string, params array<{PARAM}>, arrays map<string,array<double>>, arrayInfo {ARRAY_INFO}"
PSMS = (
    "specfile string, id string, ord long, peptide string, sequence string, score double, qValue double, pep double, eValue double, specEValue double, charge int, rank int, isValid boolean, rt double, obsMz double, excMz double"
)
FEATURES = (
    "specfile string, id string, ord long, rt double, rtLow double, rtHigh double, rtArea double, rtFwhm double, mz double, mh double, charge int, intensity double, intensityApex double, quality double, numScans int, "
    "isValid boolean, isMatched boolean, isAnnotated boolean, siIds array<string>, siiIds array<string>, peptide string, sequence string, score double, obsRt double"
)
FEATURE_GROUPS = (
    "id string, charge int, isValid boolean, isAnnotated boolean, clusterType string, specfiles array<string>, featureIds array<string>, coordinates struct<tMin:double,tMax:double,mMin:double,mMax:double>, "
    "metrics struct<timeSpread:double,massSpread:double,eucDeviation:double>, rt double, mz double, logMass double, score double, peptide string, sequence string, intensities array<double>"
)
PROTEINS = "id string, name string, sequence string, fastaHeader string, headerInfo map<string,string>, isDecoy boolean, isContaminant boolean, isUnique boolean"
PEPTIDES = "sequence string, missedCleavage int, isUnique boolean"
PEPTIDE_PROTEINS = "peptide string, proteinId string, startPos int, endPos int"
TERMS = "id string, name string, isObsolete boolean, attributes map<string,string>"
