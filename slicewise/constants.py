"""Class order, word lists, lookup tables and thresholds.

Results depend on these values (and, where noted, on their order), so they are
kept together here and passed to the operators as defaults.
"""

# The six classes, in score-vector order.
CLASSES = [
    "epidural",
    "intraparenchymal",
    "intraventricular",
    "subarachnoid",
    "subdural",
    "any",
]
SUBTYPES = CLASSES[:5]

# Order in which a study's dominant class is looked for in its labels.
DOMINANT_ORDER = [
    "subdural",
    "epidural",
    "intraparenchymal",
    "intraventricular",
    "subarachnoid",
]

CLASS_DISPLAY = {
    "epidural": "epidural hematoma",
    "intraparenchymal": "intraparenchymal hemorrhage",
    "intraventricular": "intraventricular hemorrhage",
    "subarachnoid": "subarachnoid hemorrhage",
    "subdural": "subdural hematoma",
    "any": "any intracranial hemorrhage",
}
UNDETERMINED = "intracranial hemorrhage (subtype undetermined)"

# Weights of the multi-label log loss, in class order.
LOSS_WEIGHTS = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0]

POSITIVE_AT = 0.5
HOT_PER_CLASS = 3

# Headline model numbers used when no metrics document is available.
DEFAULT_SENSITIVITY = 0.98
DEFAULT_SPECIFICITY = 0.97
DEFAULT_MEAN_AUC = 0.9877

# HU windows (low, high).
WINDOWS = {
    "wide": (-1024.0, 3071.0),
    "medium": (-200.0, 200.0),
    "narrow": (48.0, 90.0),
    "balanced": (-512.0, 512.0),
}
# Stored encoding: value * range - offset gives HU back.
STORED_OFFSET = 300.0
STORED_RANGE = 480.0
GRAY_HU = (28.0, 42.0)
BLOOD_HU = (50.0, 80.0)
OVERLAY_HU = (48.0, 90.0)
MIN_TISSUE_PIXELS = 20
SUPPORTED_BITS = [8, 16, 32, 64]

# Study descriptions holding one of these are not head studies.
NON_HEAD_WORDS = [
    "chest", "thorax", "thoracic", "abdomen", "abdominal",
    "pelvis", "pelvic", "spine", "lumbar", "cervical spine",
    "thoracic spine", "extremit", "shoulder", "knee", "ankle",
    "wrist", "elbow", "hip", "femur", "tibia", "cardiac",
    "coronary", "cardiac ct", "aorta", "renal", "hepat",
    "colono", "dental",
]
# Series descriptions: one point per wanted word, two off per unwanted word.
WANTED_SERIES_WORDS = [
    "head", "brain", "axial", "non-con", "noncon", "without",
    "ncct", "w/o", "wo", "plain", "unenhanced",
]
UNWANTED_SERIES_WORDS = [
    "perfusion", "angio", "cta", "ctp", "scout", "localizer",
    "mip", "reformat", "cor", "sag", "3d", "bone", "recon",
]
MIN_SERIES_SLICES = 10
UNKNOWN_THICKNESS = 99.0

# Department -> location. Exact key first, then the first key (in this order)
# that the department text contains.
DEPARTMENTS = {
    "emergency": "ER",
    "ed": "ER",
    "er": "ER",
    "emergency department": "ER",
    "emergency medicine": "ER",
    "trauma": "ER",
    "neurology": "Neurology",
    "neuro": "Neurology",
    "neuroscience": "Neurology",
    "neurosurgery": "Neurosurgery",
    "neuro icu": "Neuro ICU",
    "neurological icu": "Neuro ICU",
    "nicu": "Neuro ICU",
    "nsicu": "Neuro ICU",
    "icu": "ICU",
    "intensive care": "ICU",
    "micu": "ICU",
    "sicu": "ICU",
    "medical": "Med/Surg",
    "medicine": "Med/Surg",
    "internal medicine": "Med/Surg",
    "med/surg": "Med/Surg",
    "surgical": "Med/Surg",
    "outpatient": "Outpatient",
    "ambulatory": "Outpatient",
    "clinic": "Outpatient",
    "radiology": "Radiology",
    "inpatient": "Inpatient",
}

# Indication phrase -> prior, first contained phrase (in this order) wins.
INDICATION_PRIORS = {
    "trauma": 0.10,
    "loss of consciousness": 0.10,
    "altered mental": 0.08,
    "hypertension": 0.06,
    "thunderclap": 0.15,
    "worst of life": 0.15,
    "headache": 0.02,
}
DEFAULT_PRIOR = 0.05

CLASS_INDICATIONS = {
    "subdural": "Fall, altered mental status",
    "epidural": "Head trauma, loss of consciousness",
    "intraparenchymal": "Sudden onset headache, hypertension",
    "intraventricular": "Decreased level of consciousness",
    "subarachnoid": "Thunderclap headache, worst of life",
    "negative": "Headache, rule out intracranial pathology",
}
CLASS_PATIENT_NAMES = {
    "subdural": "DEMO^SUBDURAL",
    "epidural": "DEMO^EPIDURAL",
    "intraparenchymal": "DEMO^INTRAPARENCHYMAL",
    "intraventricular": "DEMO^INTRAVENTRICULAR",
    "subarachnoid": "DEMO^SUBARACHNOID",
    "negative": "DEMO^NEGATIVE",
}
DEFAULT_INDICATION = "Head CT — rule out intracranial pathology"

# Reader-vote column codes per class, in picking order.
VOTE_CODES = {
    "subdural": "SDH",
    "epidural": "EDH",
    "intraparenchymal": "IPH",
    "intraventricular": "IVH",
    "subarachnoid": "SAH",
}
READERS = ["R1", "R2", "R3"]
ANY_CODE = "ICH"

# Section markers of a free-text report.
BODY_MARKER = "REPORT BODY PARAGRAPH:"
BULLET_MARKER = "IMPRESSION BULLET POINT:"

SCREENING_NOTE = (
    "AI-assisted screening. Not FDA-cleared. Requires radiologist confirmation."
)
DISCLAIMER = (
    "AI-assisted screening tool. Not FDA-cleared for clinical use. "
    "All findings require radiologist confirmation. "
    "DICOM Structured Report is the appropriate vehicle for "
    "interactive AI finding review in a production implementation."
)

LEDGER_NUMBERS = [
    "input_tokens",
    "output_tokens",
    "cache_creation_input_tokens",
    "cache_read_input_tokens",
]
