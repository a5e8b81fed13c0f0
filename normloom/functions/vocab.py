"""Fixed values of the domain: names, patterns, labels and default numbers."""

from __future__ import annotations

# Canonical document names and the lower-case patterns that mean them, in
# order of precedence.
DOCUMENT_PATTERNS: dict[str, tuple[str, ...]] = {
    "ESPR": ("espr", "ecodesign for sustainable products"),
    "Ecodesign Directive": ("ecodesign directive", "2009/125"),
    "REACH": ("reach", "1907/2006"),
    "RoHS": ("rohs", "2011/65"),
    "WEEE": ("weee", "wee-", "wee ", "2012/19"),
    "Battery Regulation": ("battery", "2023/1542", "eu battery"),
    "CSRD": ("csrd", "2022/2464"),
    "CSDDD": ("csddd", "2024/1760"),
    "CEAP": ("circular economy action plan", "ceap", "com(2020)98"),
    "SSbD": ("ssbd", "safe-and-sustainable-by-design", "2022/2510"),
    "Green Deal": ("european green deal", "green deal", "com(2019)640"),
    "CRMA": ("critical raw materials", "crma", "2024/1252"),
    "Green Claims": ("green claims",),
    "Waste Framework": ("waste framework", "2008/98"),
    "Right to Repair": ("right to repair", "2024/1799"),
    "Chemicals Strategy": ("chemicals strategy for sustainability",),
    "Net-Zero": ("net-zero industry act", "net-zero", "net zero"),
    "PPWR": ("ppwr", "packaging and packaging waste"),
    "CBAM": ("cbam", "carbon border"),
    "EU Chips Act": ("chips act", "eu chips"),
    "Omnibus": ("omnibus",),
    "Taxonomy": ("taxonomy", "2020/852"),
    "Single Market": ("single market strategy",),
    "Conflict Minerals": ("conflict minerals", "2017/821"),
    "Competitive Compass": ("competitive compass",),
    "Clean Industrial Deal": ("clean industrial deal",),
}
# Whole names that stand for a document.
DOCUMENT_EXACT = {"net": "Net-Zero", "wee": "WEEE"}
# Documents that are binding law; all others are policy.
BINDING_LAW = (
    "ESPR", "Ecodesign Directive", "REACH", "RoHS", "WEEE", "Battery Regulation", "CSRD", "CSDDD", "CRMA", "Green Claims", "Waste Framework",
    "Right to Repair", "Net-Zero", "PPWR", "CBAM", "EU Chips Act", "Taxonomy", "Conflict Minerals",
)
GROUPS = ("binding_law", "policy_or_recommendation_docs")
# Names known in file names of evidence.
FILE_LABELS = {"ESPR": "ESPR", "REACH": "REACH", "ROHS": "RoHS", "WEE": "WEEE", "WEEE": "WEEE", "CAEP": "CAEP"}
# Alignment labels in order, and the one for unreadable answers.
LABELS = ("Aligned", "Conditional", "Conflicting", "No explicit legal basis", "Beyond compliance")
PARSE_ERROR = "PARSE_ERROR"
# Retrieval methods in report order.
METHODS = ("bm25", "dense", "rrf", "bm25_rerank", "dense_rerank", "rrf_rerank")
MODES = ("flat_baseline", "split_evidence_retrieval")
# Default numbers of retrieval and evaluation.
TOP_K, RERANK_TOP, RRF_K = 10, 5, 60
K_VALUES = (1, 3, 5, 10, 20)
CHUNK_CHARS, CHUNK_OVERLAP, ANNEX_CHARS = 2400, 320, 2000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
