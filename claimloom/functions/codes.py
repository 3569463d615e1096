"""Code lists of the Medicaid claims domain.

Everything here is a fixed value: results depend on these exact codes, so they
are stated as data and every operator takes them as parameters with these
defaults.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

# Claim types kept by claim assembly: 1 fee for service, 3 encounter.
FEE_FOR_SERVICE = "1"
ENCOUNTER = "3"
CLAIM_TYPES = (FEE_FOR_SERVICE, ENCOUNTER)

# Emergency-department signals on a claim line.
ED_REVENUE_CODES = (
    "0450", "0451", "0452", "0453", "0454", "0456", "0457", "0458", "0459", "0981",
)
ED_PLACE_CODES = (23,)
ED_PROCEDURE_CODES = ("99281", "99282", "99283", "99284", "99285")

# Dual-eligibility codes.
NOT_DUAL_CODES = ("00",)
DUAL_CODES = ("01", "02", "03", "04", "05", "06", "08", "09", "10")

# Managed-care plan types.
MANAGED_CARE_CODES = (
    "01", "02", "03", "04", "06", "07", "08", "09", "12", "14", "15", "16", "17",
    "20", "60", "70", "80",
)

# Coverage type from the CHIP code.
COVERAGE_CODES = {
    "neither": ("0",),
    "medicaid": ("1",),
    "chip": ("2", "3"),
    "both": ("4",),
}

# Age bands: label and the age at which the next one begins; from the last on it is OLDEST_BAND.
AGE_BANDS = (
    ("under10", 10),
    ("10To17", 18),
    ("18To29", 30),
    ("30To39", 40),
    ("40To49", 50),
    ("50To64", 65),
)
OLDEST_BAND = "over64"
MISSING = "missing"
# Bands that can occur in a cohort under 65, in reporting order.
COHORT_AGE_LEVELS = ("50To64", "10To17", "40To49", "30To39", "under10", "missing", "18To29")

# Demographic recodes: output column -> (source column, {label: codes}).
DEMOGRAPHIC_RECODES = {
    "death": ("DEATH_IND", {"no": ("0",), "yes": ("1",)}),
    "sex": ("SEX_CD", {"male": ("M",), "female": ("F",)}),
    "race": (
        "RACE_ETHNCTY_CD",
        {
            "white": (1,), "black": (2,), "asian": (3,), "native": (4,),
            "hawaiian": (5,), "multiracial": (6,), "hispanic": (7,),
        },
    ),
    "speakEnglish": ("ENGLSH_LANG_PRFCNCY_CD", {"yes": (0, 1), "no": (2, 3)}),
    "married": (
        "MRTL_STUS_CD",
        {
            "yes": ("01", "02", "03", "04", "05", "06", "07", "08"),
            "no": ("09", "10", "11", "12", "13", "14"),
        },
    ),
    "houseSize": (
        "HSEHLD_SIZE_CD",
        {
            "single": ("01",),
            "twoToFive": ("02", "03", "04", "05"),
            "sixorMore": ("06", "07", "08"),
        },
    ),
    "fedPovLine": (
        "INCM_CD",
        {
            "0To100": ("01",),
            "100To200": ("02", "03", "04"),
            "200AndMore": ("05", "06", "07", "08"),
        },
    ),
    "UsCitizen": ("CTZNSHP_IND", {"yes": ("1",), "no": ("0",)}),
    "ssdi": ("SSDI_IND", {"yes": ("1",), "no": ("0",)}),
    "ssi": ("SSI_IND", {"yes": ("1",), "no": ("0",)}),
    "tanf": ("TANF_CASH_CD", {"yes": (2,), "no": (0, 1)}),
}

DISABILITY_FLAGS = (
    "DSBLTY_DEAF_IND",
    "DSBLTY_BLND_IND",
    "DSBLTY_DFCLTY_CNCNTRTNG_IND",
    "DSBLTY_DFCLTY_WLKG_IND",
    "DSBLTY_DFCLTY_DRSNG_BATHNG_IND",
    "DSBLTY_DFCLTY_ERNDS_IND",
    "DSBLTY_OTHR_IND",
)

# Columns of the descriptive table.
DESCRIPTIVE_COLUMNS = (
    "ageCat", "sex", "race", "censusRegion", "houseSize", "fedPovLine", "speakEnglish",
    "married", "UsCitizen", "ssi", "ssdi", "tanf", "disabled",
)

# States left out of the cohort.
EXCLUDED_STATES = (
    "AL", "CT", "ID", "KY", "MA", "MD", "MN", "NE", "NH", "NJ", "NY", "OK", "PR", "RI",
    "TN", "TX", "UT", "VI",
)

# States with usable payment data, by kind of cost.
INPATIENT_COST_STATES = ("AK", "FL", "ME", "MT", "NM", "SD", "VA", "WY")
ED_COST_STATES = (
    "AK", "AR", "CO", "DE", "FL", "IL", "IN", "ME", "MI", "MS", "MT", "NM", "SC", "SD", "WY",
)
TOTAL_COST_STATES = ("AK", "FL", "ME", "MT", "NM", "WY")

# Census regions. Every state outside the three lists is South.
CENSUS_REGIONS = {
    "West": ("AK", "AZ", "CA", "CO", "HI", "ID", "MT", "NM", "NV", "OR", "UT", "WA", "WY"),
    "Midwest": ("IA", "IL", "IN", "KS", "MI", "MN", "MO", "ND", "NE", "OH", "SD", "WI"),
    "Northeast": ("CT", "MA", "ME", "NH", "NJ", "NY", "PA", "RI", "VT"),
}
# The published tables left AK and IA out of their lists, so both counted as South.
CENSUS_REGIONS_LEGACY = {
    region: tuple(s for s in states if s not in ("AK", "IA"))
    for region, states in CENSUS_REGIONS.items()
}
OTHER_REGION = "South"

# State postal code -> FIPS code, territories included.
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09",
    "DE": "10", "DC": "11", "FL": "12", "GA": "13", "HI": "15", "ID": "16", "IL": "17",
    "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23", "MD": "24",
    "MA": "25", "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31",
    "NV": "32", "NH": "33", "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38",
    "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46",
    "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54",
    "WI": "55", "WY": "56", "AS": "60", "GU": "66", "MP": "69", "PR": "72", "VI": "78",
}
TERRITORIES = ("AS", "GU", "MP", "PR", "VI")

# Overlap labels of an event against the one before it (there is no label 4).
FIRST = "1.First"
NEW_EPISODE = "2.New Episode"
REGULAR_OVERLAP = "3.Regular Overlap"
SAME_START = "5.Same Start Date (SRO)"
EMBEDDED = "6.Embedded"
PERFECT_OVERLAP = "7.Perfect Overlap"

# Probabilities of the ED score lookup that count as avoidable, and the cut-offs.
ED_SCORE_PARTS = ("ednp", "pct", "nonemergent")
ED_THRESHOLD = 0.5
ED_THRESHOLDS = (0.0, 0.5, 0.75, 0.9)

# Measures of the county roll-up checked by small-cell suppression.
SUPPRESSED_MEASURES = (
    "non_avoid_ip", "avoid_ip", "non_avoid_ed", "avoid_ed", "non_emergent_acute",
    "emergent_acute", "all_cause_acute", "total_ip", "total_ed",
)
SMALL_CELL = 11
MINIMUM_MEMBERS = 100

# Quantile points of the published distributions.
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
SIZE_POINTS = (
    0.0, 0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0,
)
