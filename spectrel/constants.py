"""Masses, modifications and cleavage rules."""

from __future__ import annotations

# Monoisotopic element masses.
ELEMENTS = {"H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "S": 31.97207100, "P": 30.97376163, "C[13]": 13.0033548378, "H[2]": 2.0141017778}
ATOMIC_MASS_H = 1.00782504
PROTON = 1.00727646677
#: Difference between neighbouring isotope peaks.
ISOTOPE_STEP = 1.003355

# Elemental compositions of residues.
RESIDUE_COMPOSITIONS = {
    "A": {"H": 5, "C": 3, "O": 1, "N": 1},
    "C": {"H": 5, "C": 3, "S": 1, "O": 1, "N": 1},
    "D": {"H": 5, "C": 4, "O": 3, "N": 1},
    "E": {"H": 7, "C": 5, "O": 3, "N": 1},
    "F": {"H": 9, "C": 9, "O": 1, "N": 1},
    "G": {"H": 3, "C": 2, "O": 1, "N": 1},
    "H": {"H": 7, "C": 6, "N": 3, "O": 1},
    "I": {"H": 11, "C": 6, "O": 1, "N": 1},
    "K": {"H": 12, "C": 6, "N": 2, "O": 1},
    "L": {"H": 11, "C": 6, "O": 1, "N": 1},
    "M": {"H": 9, "C": 5, "S": 1, "O": 1, "N": 1},
    "N": {"H": 6, "C": 4, "O": 2, "N": 2},
    "P": {"H": 7, "C": 5, "O": 1, "N": 1},
    "Q": {"H": 8, "C": 5, "O": 2, "N": 2},
    "R": {"H": 12, "C": 6, "N": 4, "O": 1},
    "S": {"H": 5, "C": 3, "O": 2, "N": 1},
    "T": {"H": 7, "C": 4, "O": 2, "N": 1},
    "V": {"H": 9, "C": 5, "O": 1, "N": 1},
    "W": {"C": 11, "H": 10, "N": 2, "O": 1},
    "Y": {"H": 9, "C": 9, "O": 2, "N": 1},
}
# Elemental compositions of modifications, by Unimod number or short name.
MODIFICATION_COMPOSITIONS = {
    "u:1": {"C": 2, "H": 2, "O": 1},
    "u:3": {"C": 10, "H": 14, "N": 2, "O": 2, "S": 1},
    "u:4": {"C": 2, "H": 3, "N": 1, "O": 1},
    "u:5": {"C": 1, "H": 1, "N": 1, "O": 1},
    "u:7": {"H": -1, "N": -1, "O": 1},
    "u:21": {"H": 1, "O": 3, "P": 1},
    "u:27": {"H": -2, "O": -1},
    "u:28": {"H": -3, "N": -1},
    "u:34": {"C": 1, "H": 2},
    "u:35": {"O": 1},
    "u:36": {"C": 2, "H": 4},
    "u:121": {"C": 4, "H": 6, "N": 2, "O": 2},
    "u:188": {"C": -6, "C[13]": 6},
    "u:199": {"H[2]": 4, "C": 2},
    "u:374": {"H": -1},
    "u:1020": {"C": 8, "H": 12, "O": 3},
    "u:1356": {"C": 5, "H": 9, "O": 7, "P": 1},
    "DSS": {"C": 8, "H": 10, "O": 2},
    "*": {},
}
# Unimod titles of the modifications above.
UNIMOD_TITLES = {
    "Acetyl": "1", "Biotin": "3", "Carbamidomethyl": "4", "Carbamyl": "5", "Deamidated": "7", "Phospho": "21", "Glu->pyro-Glu": "27", "Gln->pyro-Glu": "28", "Methyl": "34", "Oxidation": "35",
    "Dimethyl": "36", "GG": "121", "GlyGly": "121", "Label:13C(6)": "188", "Dimethyl:2H(4)": "199", "Dehydro": "374",
}
# Cleavage rules of enzymes, as regular expressions that end where the cut is.
CLEAVAGE_RULES = {
    "arg-c": r"R",
    "asp-n": r"\w(?=D)",
    "bnps-skatole": r"W",
    "caspase 1": r"(?<=[FWYL]\w[HAT])D(?=[^PEDQKR])",
    "caspase 10": r"(?<=IEA)D",
    "caspase 2": r"(?<=DVA)D(?=[^PEDQKR])",
    "caspase 3": r"(?<=DMQ)D(?=[^PEDQKR])",
    "caspase 4": r"(?<=LEV)D(?=[^PEDQKR])",
    "caspase 5": r"(?<=[LW]EH)D",
    "caspase 6": r"(?<=VE[HI])D(?=[^PEDQKR])",
    "caspase 7": r"(?<=DEV)D(?=[^PEDQKR])",
    "caspase 8": r"(?<=[IL]ET)D(?=[^PEDQKR])",
    "caspase 9": r"(?<=LEH)D",
    "chymotrypsin high specificity": r"([FY](?=[^P]))|(W(?=[^MP]))",
    "chymotrypsin low specificity": r"([FLY](?=[^P]))|(W(?=[^MP]))|(M(?=[^PY]))|(H(?=[^DMPW]))",
    "clostripain": r"R",
    "cnbr": r"M",
    "enterokinase": r"(?<=[DE]{3})K",
    "factor xa": r"(?<=[AFGILTVM][DE]G)R",
    "formic acid": r"D",
    "glutamyl endopeptidase": r"E",
    "granzyme b": r"(?<=IEP)D",
    "hydroxylamine": r"N(?=G)",
    "iodosobenzoic acid": r"W",
    "lysc": r"K",
    "ntcb": r"\w(?=C)",
    "pepsin ph1.3": r"((?<=[^HKR][^P])[^R](?=[FLWY][^P]))|((?<=[^HKR][^P])[FLWY](?=\w[^P]))",
    "pepsin ph2.0": r"((?<=[^HKR][^P])[^R](?=[FL][^P]))|((?<=[^HKR][^P])[FL](?=\w[^P]))",
    "proline endopeptidase": r"(?<=[HKR])P(?=[^P])",
    "proteinase k": r"[AEFILTVWY]",
    "staphylococcal peptidase i": r"(?<=[^E])E",
    "thermolysin": r"[^DE](?=[AFILMV])",
    "thrombin": r"((?<=G)R(?=G))|((?<=[AFGILTVM][AFGILTVWA]P)R(?=[^DE][^DE]))",
    "trypsin": r"([KR](?=[^P]))|((?<=W)K(?=P))|((?<=M)R(?=P))",
    "trypsin simple": r"[KR]",
}


def composition_mass(composition: dict[str, int]) -> float:
    return sum(ELEMENTS[element] * n for element, n in composition.items())


RESIDUE_MASSES = {name: composition_mass(c) for name, c in RESIDUE_COMPOSITIONS.items()}
MODIFICATION_MASSES = {name: composition_mass(c) for name, c in MODIFICATION_COMPOSITIONS.items()}
MODIFICATION_MASSES |= {"UNIMOD:" + name[2:]: mass for name, mass in list(MODIFICATION_MASSES.items()) if name.startswith("u:")}
WATER = composition_mass({"H": 2, "O": 1})
