"""Words and codes the source systems use, and the columns of the finished tables."""

# care-plan items of the offset-time source
OFFSET_CODE_WORDS = {
    "dnr": (
        "Do not resuscitate",
        "Advance directives",
        "No cardioversion",
        "No CPR",
        "No intubation",
        "No vasopressors/inotropes",
    ),
    "cmo": ("Comfort measures only", "No augmentation of care", "No blood draws", "No blood products"),
    "fullcode": ("Full therapy",),
}

# chart items of the timestamp source
TIMESTAMP_CODE_WORDS = {
    "fullcode": ("Full Code", "Full code"),
    "cmo": ("Comfort Measures", "Comfort measures only"),
    "dnr": ("Do Not Resuscita", "DNR (do not resuscitate)", "DNR / DNI"),
    "dni": ("Do Not Intubate", "DNI (do not intubate)", "DNR / DNI"),
    "dncpr": ("CPR Not Indicate",),
}
CODE_STATUS_ITEMS = (128, 223758)
HEART_RATE_ITEMS = (211, 220045)
CODE_STATUS_IGNORED = "Other/Remarks"

# ethnic groups of the offset-time source
OFFSET_ETHNICITY = {"race_black": "African American", "race_hispanic": "Hispanic", "race_asian": "Asian"}

# ethnic groups of the timestamp source
TIMESTAMP_ETHNICITY = {
    "race_black": (
        "BLACK/AFRICAN AMERICAN", "BLACK/CAPE VERDEAN", "BLACK/HAITIAN", "BLACK/AFRICAN", "CARIBBEAN ISLAND",
    ),
    "race_hispanic": (
        "HISPANIC OR LATINO", "HISPANIC/LATINO - PUERTO RICAN", "HISPANIC/LATINO - DOMINICAN",
        "HISPANIC/LATINO - GUATEMALAN", "HISPANIC/LATINO - CUBAN", "HISPANIC/LATINO - SALVADORAN",
        "HISPANIC/LATINO - CENTRAL AMERICAN (OTHER)", "HISPANIC/LATINO - MEXICAN", "HISPANIC/LATINO - COLOMBIAN",
        "HISPANIC/LATINO - HONDURAN",
    ),
    "race_asian": (
        "ASIAN", "ASIAN - CHINESE", "ASIAN - ASIAN INDIAN", "ASIAN - VIETNAMESE", "ASIAN - FILIPINO",
        "ASIAN - CAMBODIAN", "ASIAN - OTHER", "ASIAN - KOREAN", "ASIAN - JAPANESE", "ASIAN - THAI",
    ),
    "race_other": (
        "UNKNOWN/NOT SPECIFIED", "OTHER", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER", "MULTI RACE ETHNICITY",
        "PORTUGUESE", "AMERICAN INDIAN/ALASKA NATIVE", "MIDDLE EASTERN",
        "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "SOUTH AMERICAN",
        "AMERICAN INDIAN/ALASKA NATIVE FEDERALLY RECOGNIZED TRIBE",
    ),
}

EXCLUSIONS = ("exclusion_non_adult", "exclusion_bad_data", "exclusion_organ_donor", "exclusion_by_apache")
LIMITS = ("censortime_hours", "deathtime_hours", "dischtime_hours")
OUTCOMES = ("hospitalid", "death", "hosp_los", "ventdays")
STATIC_INPUTS = ("is_female", "age", "race_black", "race_hispanic", "race_asian", "race_other", "electivesurgery")
