"""The vocabulary in which the atlas is asked: phrases of fields and comparisons that mean the same."""

from __future__ import annotations

from tessera.llm.overlap import Grammar

FIELDS = {
    "dsasa_total": ["buried surface", "buried area", "total buried surface", "total buried area", "buried surface area"],
    "mw": ["ligand weight", "compound mass", "ligand mass", "compound weight", "molecular weight"],
    "buried_fraction": ["buried fraction", "covered share of the ligand", "covered share", "fraction buried"],
    "bridging_balance": ["bridging balance", "side balance", "balance"],
    "resolution": ["resolution", "map resolution"],
    "ccd_class": ["ligand class", "compound class", "class"],
    "method": ["method", "experiment type", "experimental method", "experiment"],
    "cb_cb_distance": ["distance between beta carbons", "beta carbon distance", "beta carbons distance"],
    "nz_centroid_distance": ["centroid distance", "distance to the site centre", "distance to the centroid", "distance to the site center"],
    "nz_rel_sasa": ["side chain exposure", "amine exposure", "exposure of the side chain"],
    "observed_digly": ["observed modification", "modification observed", "modification"],
    "pocket_volume_a3": ["pocket volume", "cavity size", "cavity volume", "pocket size"],
    "pocket_score": ["pocket score", "best pocket score"],
    "triage_score": ["triage score", "shortlist score"],
    "family": ["family", "ligase family"],
    "exploitation_status": ["exploitation status", "use so far"],
    "tip_rel_sasa": ["tip exposure", "exposure at the tip", "exposure of the tip"],
    "mean_plddt": ["mean confidence", "average model confidence", "model confidence", "mean model confidence", "average confidence"],
    "degron_geometry_score": ["geometry score", "loop geometry score"],
    "tip_aa": ["tip residue", "residue at the tip", "residue at the turn tip", "turn residue"],
    "motif_family": ["motif family", "motif", "motif class"],
}
COMPARISONS = {
    "lt": ["less than", "below", "under", "smaller than", "lower than", "beneath", "<"],
    "lte": ["at most", "no more than", "not above", "not more than", "no greater than", "not over", "not exceeding", "up to", "<=", "≤"],
    "gt": ["greater than", "above", "over", "exceeding", "more than", "larger than", "higher than", "bigger than", ">"],
    "gte": ["at least", "no less than", "not below", "not less than", "not under", "no smaller than", "no lower than", ">=", "≥"],
    "eq": ["equal to", "being", "of", "that is", "is", "equals", "="],
    "ne": ["other than", "different from", "that is not", "is not", "not equal to", "not being", "not", "!=", "≠"],
}
VALUES = ["x ray", "nmr", "cryo em", "yes", "no", "inhibitor", "buffer salt", "metal", "unclassified", "lipid like", "linker", "sugar", "glue like", "cofactor", "degrader like", "rbr", "ring", "hect", "u box", "cullin adaptor", "ligandable", "exploited", "untouched", "beta turn", "helix cap"]
FILLER = [
    "show", "give me", "give", "find", "pull up", "return", "list", "fetch", "get", "ligands", "bridges", "ligand bridges", "bridging ligands", "lysines", "lysine sites", "acceptor lysines", "ligases", "e3 ligases", "e3s", "degrons", "degron candidates", "hairpin candidates",
    "top of the list only", "highest first", "lowest first", "please", "thanks", "thank you", "cheers", "hi", "hello", "quick one", "could you", "can you", "would you", "i would like you to", "if you can", "for the group meeting", "for the slide deck", "needed today", "needed now", "today", "now",
]
REQUESTS = Grammar(FIELDS, COMPARISONS, VALUES, FILLER)
