"""Curated look-alike rules and naming rules.

Everything in this file is a fixed value: the fragments decide which similar names stay apart, so they
must be exactly these. Each entry reads "a name with the first fragment and a name with the second
fragment are different things".
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NamingRules:
    mismatches: tuple[tuple[str, str], ...]
    drop: tuple[str, ...] = ()
    fold_case: bool = False
    replace: dict[str, str] = field(default_factory=dict)


# 2012 rules, human.
SAPIENS = NamingRules(
    mismatches=(
        ("NOD", "Toll"), ("Linoleic", "Lipoic"), ("T cell", "B cell"), ("EPO", "TOR"), ("L-cysteine", "lysine"),
        ("spermine", "serine"), ("serotonin", "serine"), ("Steroid", "thyroid"), ("isoleucine", "leucine"),
        ("dermatan", "heparan"), ("ribonucleotides", "deoxyribonucleotides"), ("guanosine", "adenosine"),
        ("sulfation", "oxidation"), ("Glycerolipid", "Glycerophospholipid"),
    ),
    drop=("", "-", "I", "II", "III", "IV", "Small", "Type", "V", "VI", "X", "adenosine", "globo", "heparan", "keratan"),
    replace={"glycolysis": "Glycolysis and Gluconeogenesis"},
)
# 2012 rules, mouse.
MUSCULUS = NamingRules(
    mismatches=(
        ("NOD", "Toll"), ("Linoleic", "Lipoic"), ("T cell", "B cell"), ("L-cysteine", "lysine"),
        ("spermine", "serine"), ("serotonin", "serine"), ("Steroid", "thyroid"), ("dermatan", "heparan"),
        ("ribonucleotides", "deoxyribonucleotides"), ("guanosine", "adenosine"), ("phenylalanine", "alanine"),
        ("serine", "Steroid"), ("T Cell", "B Cell"), ("lactose", "galactose"), ("galactosamine", "glucosamine"),
        ("purine", "pyrimidine"), ("deoxy", "ribose"), ("GMP", "AMP"), ("VEGF", "EGFR1"),
        ("methylglyoxal", "methylation"), ("Glycerolipid", "Glycerophospholipid"),
    ),
    drop=("", "(from", "(unsaturated,", "ADP-D-Glucose)", "I", "II", "III", "IV", "Small", "Type", "V", "VI", "X",
          "adenosine", "branch", "even", "globo", "heparan", "keratan", "number)", "pathway"),
    replace={"o-glycan": "Glycan", "il-2": "Interleukin", "ubiquinone-8": "ubiquinone",
             "glycolysis": "Glycolysis and Gluconeogenesis", "3-hydroxypropionate": "3-/4-hydroxypropionate",
             "leucine": "Valine, leucine and isoleucine"},
)
# 2012 rules, yeast.
CEREVISIAE = NamingRules(
    mismatches=(
        ("NOD", "Toll"), ("Linoleic", "Lipoic"), ("T cell", "B cell"), ("EPO", "TOR"), ("L-cysteine", "lysine"),
        ("spermine", "serine"), ("serotonin", "serine"), ("Steroid", "thyroid"), ("dermatan", "heparan"),
        ("ribonucleotides", "deoxyribonucleotides"), ("guanosine", "adenosine"), ("sulfation", "oxidation"),
        ("Lysine", "Glycine"), ("Serine", "homoserine"), ("galactose", "Lactose"),
        ("alanine biosynthesis", "Valine Biosynthesis"), ("valine biosynthesis", "alanine biosynthesis"),
        ("oleate", "folate"), ("glutaredoxin", "thioredoxin"), ("homoserine", "homocysteine"),
        ("valine degradation", "alanine degradation"), ("phenylalanine biosynthesis", "alanine biosynthesis"),
        ("glutathione", "glutamine"), ("S-adenosylmethionine", "Methionine"),
        ("Glycerolipid", "Glycerophospholipid"), ("guanine, xanthine", "adenine, hypoxanthine"),
    ),
    drop=("", ",", "-", "I", "II", "III", "IV", "Small", "Type", "V", "VI", "X", "adenosine", "globo", "heparan",
          "keratan", "saturated"),
    fold_case=True,
    replace={"o-glycan": "Glycan", "il-2": "Interleukin", "ubiquinone-8": "ubiquinone",
             "palmitate": "palmitoleate and palmitate", "glycolysis": "Glycolysis and Gluconeogenesis",
             "deoxyribose": "Ribose and Deoxyribose", "leucine": "Valine, leucine and isoleucine",
             "spermine": "spermine, spermidine"},
)
# 2012 rules, M. tuberculosis.
TUBERCULOSIS = NamingRules(
    mismatches=(
        ("NOD", "Toll"), ("Linoleic", "Lipoic"), ("T cell", "B cell"), ("EPO", "TOR"), ("L-cysteine", "lysine"),
        ("spermine", "serine"), ("serotonin", "serine"), ("Steroid", "thyroid"), ("spermidine", "serine"),
        ("dermatan", "heparan"), ("ribonucleotides", "deoxyribonucleotides"), ("guanosine", "adenosine"),
        ("sulfation", "oxidation"), ("Lysine", "Glycine"), ("glycine biosynthesis I", "lysine biosynthesis I"),
        ("Serine", "homoserine"), ("galactose", "Lactose"), ("Nitrotoluene", "Toluene"),
        ("alanine biosynthesis", "Valine Biosynthesis"), ("Fluorobenzoate degradation", "Benzoate"),
        ("valine biosynthesis", "alanine biosynthesis"), ("oleate", "folate"), ("glutaredoxin", "thioredoxin"),
        ("homoserine", "homocysteine"), ("valine degradation", "alanine degradation"),
        ("Fluorobenzoate", "Benzoate"), ("enterobactin", "antigen"), ("glutathione", "glutamine"),
        ("S-adenosylmethionine", "Methionine"), ("Aminobenzoate degradation", "Benzoate degradation"),
        ("deoxy", "ribose degradation"), ("Glycerolipid", "Glycerophospholipid"),
        ("demethylmenaquinone-8 biosynthesis I", "menaquinone-8 biosynthesis"),
    ),
    drop=("", ",", "-", "I", "II", "III", "IV", "Small", "Type", "V", "VI", "X", "adenosine", "globo", "heparan",
          "keratan", "saturated"),
    fold_case=True,
    replace={"o-glycan": "Glycan", "il-2": "Interleukin", "glycolysis": "Glycolysis and Gluconeogenesis",
             "4-aminobutyrate": "arginine, putrescine, and 4-aminobutyrate", "alanine": "alanine and phenylalanine",
             "leucine": "leucine and isoleucine", "ornithine": "arginine and ornithine",
             "spermine": "spermine, spermidine", "folate": "Folate and tetrahydrofolate"},
)
LEGACY = {"sapiens": SAPIENS, "musculus": MUSCULUS, "cerevisiae": CEREVISIAE, "tuberculosis": TUBERCULOSIS}

# Rules added for the larger vocabularies of the current generation.
ADDED_MISMATCHES = (
    ("VEGF", "EGF"), ("EGFR", "VEGFR"), ("Type I ", "Type II "), ("type I ", "type II "), ("MAPK", "MAP2K"),
    ("IL-1", "IL-17"), ("IL-2", "IL-12"), ("IL-3", "IL-13"), ("IL-4", "IL-14"), ("IL-6", "IL-16"),
    ("mTORC1", "mTORC2"), ("Class I ", "Class II "), ("biosynthesis", "degradation"), ("anabolism", "catabolism"),
    ("synthesis", "degradation"), ("activation", "inhibition"), ("positive regulation", "negative regulation"),
    ("Non-alcoholic", "Alcoholic liver"), ("Nonalcoholic", "Alcoholic liver"), ("Hepatitis B", "Hepatitis C"),
    ("Prion", "Parkinson"), ("EPO receptor", "Hepatocyte growth factor receptor"), ("Rap1", "Ras signaling"),
    ("Renin secretion", "Insulin secretion"), ("Osteoblast", "Osteoclast"), ("Omega 3", "Omega 6"),
    ("Carbohydrate digestion", "Fat digestion"), ("Non-small cell", "Small cell lung"),
    ("Non small cell", "Small cell lung"), ("Integrated breast cancer", "Integrated cancer pathway"),
    ("Focal adhesion PI3K", "PI3K Akt signaling"), ("Focal adhesion PI3K", "PI3K-Akt signaling"),
    ("Vitamins", "Vitamin D"), ("Neolacto series", "Lacto series"),
    ("biosynthesis - ganglio series", "Glycosphingolipid biosynthesis"),
    ("biosynthesis - globo and isoglobo series", "Glycosphingolipid biosynthesis"),
    ("biosynthesis - lacto and neolacto series", "Glycosphingolipid biosynthesis"),
    ("Alternative complement", "Classical antibody-mediated complement"),
    ("Dengue 2 interactions", "Complement and coagulation cascades"),
    ("Hippo Merlin signaling dysregulation", "Hippo signaling regulation"),
)


def rules_for(organism: str | None, legacy: bool) -> NamingRules:
    """Rules of one organism (legacy; unknown organisms use the human list), else the union of all lists."""
    if legacy:
        return LEGACY.get(organism or "", SAPIENS)
    union = dict.fromkeys(pair for rules in LEGACY.values() for pair in rules.mismatches)
    return NamingRules(tuple(union) + ADDED_MISMATCHES, SAPIENS.drop, False, SAPIENS.replace)
