"""The word lists, patterns and names that results depend on."""

# Month names.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

# Finite verbs that carry the main clause of a legal sentence.
FINITE = (
    "ist", "sind", "war", "waren", "sei", "seien", "wird", "werden", "wurde", "wurden", "hat", "haben", "hatte", "hatten", "kann", "können", "darf", "dürfen", "muss", "müssen", "soll", "sollen",
    "gilt", "gelten", "galt", "galten", "bleibt", "bleiben", "beträgt", "betragen", "bemisst", "bemessen", "unterliegt", "unterliegen", "entsteht", "entstehen", "erlischt", "erlöschen",
    "findet", "finden", "ergibt", "ergeben", "tritt", "treten", "steht", "stehen", "bedarf", "bedürfen", "erfolgt", "erfolgen", "endet", "enden", "beginnt", "beginnen",
    "richtet", "richten", "zählt", "zählen", "gehört", "gehören", "umfasst", "umfassen", "stand", "standen", "greift", "greifen", "liegt", "liegen",
    "übersteigt", "übersteigen", "erhöht", "vermindert", "ermäßigt", "ändert", "ändern",
)

# Words of four letters or more that carry no content.
FILLERS = ("diese", "dieser", "dieses", "diesem", "diesen", "einer", "eines", "einem", "einen", "oder", "sowie", "auch", "nach", "nicht", "dabei", "hierbei", "insoweit", "jeweils")

# Words that don't count when spans are compared with gold data.
STOP_WORDS = (
    "der", "die", "das", "des", "dem", "den", "ein", "eine", "eines", "einer", "und", "oder", "nach", "für", "bei", "von", "vom", "zur", "zum", "auf", "ist", "sind", "wird", "werden", "einkommensteuergesetzes", "gesetzes",
)

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Abs", "Art", "Nr", "Nrn", "Buchst", "Halbs", "Alt", "lit", "S", "Sätze", "vgl", "bzw", "ca", "Bek", "BGBl", "BStBl", "ggf", "evtl", "inkl", "entspr", "z", "B", "i", "d", "u", "a", "v", "f", "ff", "Hs", "Tz", "Rz", "Anm", "Nds", "EStR", "EStH",
)

# Entities of handbook pages.
HANDBOOK_ENTITIES = (
    ("(?i)&sect;|&#167;", "§"), ("(?i)&nbsp;|&#160;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"),
)

# Kinds of spans, and which norm types a gold type accepts.
KINDS = ("tb", "rf", "ausn", "def")
TYPE_MATCHES = {
    "konditional": ("rule", "konditional", "gemischt"),
    "berechnung": ("calculation", "rule", "tarif", "gemischt", "konditional"),
    "tarif": ("calculation", "tarif", "gemischt"),
    "verweisung": ("reference_only", "verweisung"),
    "anwendung": ("no_classic_rule", "reference_only", "anwendung", "ohne_merkmale"),
    "kollision": ("rule", "konditional"),
    "gemischt": ("rule", "gemischt", "konditional"),
    "definition": ("definition",),
    "gegennorm": ("rule", "konditional"),
}

# What a paragraph of each type does.
ROLES = {
    "konditional": "Voraussetzungen und Rechtsfolge",
    "definition": "Begriffsbestimmung",
    "gleichstellung": "Gleichstellung",
    "fiktion": "Fiktion",
    "tarif": "Bemessung und Satz",
    "verweisung": "Verweisung",
    "rechenregel": "Rechenregel",
    "aussage": "Anordnung",
}
