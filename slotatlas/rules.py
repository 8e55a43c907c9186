"""Rule tables. They decide results and must stay as they are."""

# --- weekdays ---------------------------------------------------------------
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_WORDS = {
    "en": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    "de": ["montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonntag"],
    "fr": ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"],
    "it": ["lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica"],
    "it_plain": ["lunedi", "martedi", "mercoledi", "giovedi", "venerdi", "sabato", "domenica"],
    "en_short": ["mon", "tue", "wed", "thu", "fri", "sat", "sun"],
}
# Two-letter forms depend on the language: "di" is Tuesday in German, Sunday in French.
DAY_SHORT = {
    "de": ["mo", "di", "mi", "do", "fr", "sa", "so"],
    "fr": ["lu", "ma", "me", "je", "ve", "sa", "di"],
    "it": ["lu", "ma", "me", "gi", "ve", "sa", "do"],
}

# --- data quality bounds ------------------------------------------------------
PRICE_FIELDS = ["single", "card_10", "monthly", "trial"]
PRICE_RANGES = {"single": (10, 60), "card_10": (80, 500), "monthly": (50, 400), "trial": (0, 80)}
IMPOSSIBLE_PRICES = {"single": (3, 100), "card_10": (60, 700), "monthly": (40, 600), "trial": (0, 120)}
RATIO_CARD10 = (7, 12)
RATIO_MONTHLY = (4, 10)
LAT_BOUNDS = (45.8, 47.9)
LNG_BOUNDS = (5.9, 10.5)
MIN_HOUR, MAX_HOUR = 5, 23
MIN_DURATION, MAX_DURATION = 30, 180
CLOSE_DEGREES = 0.001
CHANGE_PCT, CHANGE_PCT_HIGH = 20, 50

# --- amounts ------------------------------------------------------------------
AMOUNT_PATTERNS = [
    r"CHF\s*(\d+(?:[.,]\d{1,2})?)",
    r"(\d+(?:[.,]\d{1,2})?)\s*CHF",
    r"Fr\.?\s*(\d+(?:[.,]\d{1,2})?)",
    r"(\d+(?:[.,]\d{1,2})?)\s*Fr\b",
    r"SFr\.?\s*(\d+(?:[.,]\d{1,2})?)",
    r"(\d+(?:[.,]\d{1,2})?)\s*(?:Franken|francs?)",
    r"(\d+)\s*\.\s*[-–]",
]
AMOUNT_BOUNDS = (5, 10000)
NEAR_BOUNDS = (5, 5000)
NEAR_CHARS = 150
PRICE_KEYWORDS = {
    "single": (
        r"(?:einzelstunde|einzellektion|einzeleintritt|single\s*class|drop[- ]?in|"
        r"kurse?\s*(?:60|75|90)\s*min|lezione?\s*(?:singola|unica)|"
        r"cours?\s*(?:individuel|unique|[àa]\s*l.unit[eé])|"
        r"1\s*(?:lektion|class|cours)|pro\s*lektion|per\s*lezione|par\s*cours|"
        r"class\s*pass|yoga\s*class|einzeln|einzel|"
        r"per\s*class|per\s*session|pro\s*stunde|pro\s*klasse|"
        r"single\s*entry|einmalig|une\s*séance|par\s*séance|"
        r"classe\s*individuelle|singola\s*lezione|"
        r"1x|one\s*class|une\s*classe|lezione\s*singola)"),
    "card_10": (
        r"(?:10er|10[- ]?(?:class|karte|lektionen|cours|lezioni|er\s*(?:karte|abo))|"
        r"(?:carte?|pass|abo|carnet)\s*(?:de?\s*)?10|"
        r"10\s*(?:classes?|lektionen|cours|lezioni|entrées?|séances?|lezioni)|"
        r"block\s*(?:of\s*)?10|zehnerkarte|"
        r"5er|5\s*(?:classes?|lektionen)|"
        r"(?:carte?|pass|abo|carnet)\s*(?:de?\s*)?5)"),
    "monthly": (
        r"(?:monats?\s*abo|monthly|monatlich|unlimited\s*(?:1\s*)?month|"
        r"illimit[eé]|mensuel|abo\s*(?:un)?limit[eé]?|"
        r"flatrate|flat\s*rate|all\s*you\s*can\s*yoga|jahres?\s*abo|annual|"
        r"abo\s*\d+\s*monat|abonnement\s*mensuel|monats\s*flat|"
        r"unlimited\s*yoga|mitgliedschaft|membership|"
        r"abbonamento\s*mensile|mese|monat\s*(?:abo|flat)|"
        r"abo\s*mensuel|subscription\s*month)"),
    "trial": (
        r"(?:probe|trial|schnupper|essai|d[eé]couverte|prova|kennen\s*lern|intro|"
        r"first\s*class|premier\s*cours|erste?\s*(?:lektion|stunde)|"
        r"new\s*student|new\s*client|newcomer|neueinsteiger|"
        r"beginner\s*offer|try\s*out|promo|aktion|offre\s*d.essai|"
        r"angebots?\s*paket|starter|welcome|"
        r"prima\s*lezione|prova\s*gratuita|"
        r"nouveau\s*client|nouvelle?\s*[eé]l[eè]ve|"
        r"kennenlernen|reinschnuppern|test\s*class)"),
}
FREE_TRIAL_PATTERNS = [
    r"(?:probe|trial|schnupper|essai)[^.]{0,40}?(?:gratis|free|kostenlos|gratuit)",
    r"(?:gratis|free|kostenlos|gratuit)[^.]{0,40}?(?:probe|trial|schnupper|essai)",
    r"erste?\s*(?:stunde|lektion|class)[^.]{0,30}?(?:gratis|free|kostenlos|gratuit)",
    r"(?:gratis|free|kostenlos|gratuit)[^.]{0,30}?erste?\s*(?:stunde|lektion|class)",
    r"prima\s*lezione\s*(?:gratis|gratuit)",
]
FREE_TRIAL_NOISE = r"(?:specs|config|settings)\.\w+\.(?:support)?free\w*"
FREE_TRIAL_GUARD = ["specs.", "config.", '"true"', '"false"', "wix"]
PRICE_PAGE = r"(?:preis|price|pricing|tarif|prix|angebot|prezz|cost|abo|membership|offre|kosten)"
CATEGORY_AMOUNT = r"CHF\s*(\d+[\.,]?\d*)"
CATEGORY_KEYWORDS = {
    "single": ["einzeleintritt", "einzellektion", "drop-in", "drop in", "single class",
               "cours unique", "einzelstunde", "einzelkurs"],
    "card_10": ["10er", "10-er", "10 er", "10 lektionen", "10 classes", "10 cours",
                "10er-abo", "10er abo", "10er-karte"],
    "monthly": ["monats", "monatlich", "monthly", "mensuel", "monatsabo", "month"],
    "trial": ["probestunde", "probelektion", "schnuppern", "trial", "cours d'essai",
              "probetraining", "first class", "erste stunde"],
    "abo": ["abo", "abonnement", "subscription", "mitgliedschaft", "membership"],
}
CATEGORY_BOUNDS = (5, 500)

# --- platforms and links --------------------------------------------------------
PLATFORM_PATTERNS = [
    ("Eversports", "eversports"),
    ("Momoyoga", "momoyoga"),
    ("MindBody", "mindbody|healcode"),
    ("Kursifant", "kursifant"),
    ("FitogramPro", "fitogram"),
    ("TeamUp", "teamup|goteamup"),
    ("Glofox", "glofox"),
    ("Supersaas", "supersaas"),
    ("Bookeo", "bookeo"),
]
LINK_PLATFORMS = ["eversports", "mindbody", "momoyoga", "fitogram", "classpass"]
SPONSORED_HOSTS = ["eversports.", "classpass.", "mindbody", "momoyoga.", "fitogram."]
EMBED_PATTERNS = {
    "eversports": [
        r"eversports\.ch/widget/w/([a-zA-Z0-9_-]+)",
        r"facilityShortId=([a-zA-Z0-9_-]+)",
        r"eversports\.ch/s/([a-zA-Z0-9_-]+)",
        r"data-eversports-widget-id=[\"']([a-zA-Z0-9_-]+)",
        r"eversports\.com/widget/w/([a-zA-Z0-9_-]+)",
        r"eversports\.[a-z]+/(?:s|studio|widget/w)/([a-zA-Z0-9_-]+)",
    ],
    "sportsnow": [r"sportsnow\.ch/(?:go|providers)/([a-zA-Z0-9_-]+)"],
    "momoyoga": [r"momoyoga\.com/([a-zA-Z0-9_-]+)"],
    "bsport": [r"(?:bfrnd\.com|bsport\.io)/([a-zA-Z0-9_-]+)",
               r"backoffice\.bsport\.io/m/([a-zA-Z0-9_-]+)"],
    "mindbody": [r"studioid=(\d+)", r"data-studioid=[\"']?(\d+)",
                 r"brandedweb\.mindbodyonline\.com/.*?studioid=(\d+)",
                 r"widgets\.mindbodyonline\.com/.*?(\d{5,})"],
    "acuity": [r"squarespacescheduling\.com/schedule\.php\?owner=(\d+)",
               r"acuityscheduling\.com/schedule\.php\?owner=(\d+)"],
    "fitogram": [r"widget\.fitogram\.pro/([a-zA-Z0-9_-]+)", r"fitogram\.pro/([a-zA-Z0-9_-]+)"],
}
EMBED_STOP = {
    "momoyoga": ["yoga", "en", "de", "fr", "it", "embed", "widget", "css", "js"],
    "bsport": ["en", "fr", "de", "it", "js", "css", "widget"],
    "fitogram": ["en", "de", "fr", "widget", "js", "css"],
}
FILE_SUFFIXES = [".pdf", ".jpg", ".png", ".gif", ".zip", ".mp4"]
SCHEDULE_LINK_WORDS = [
    "stundenplan", "schedule", "classes", "kurse", "horaire", "timetable", "angebot", "cours",
    "orario", "programm", "kursplan", "yoga", "offering", "termine", "daten", "planning",
    "emploi", "planning-cours",
]
SCHEDULE_SUBPATHS = ["/stundenplan", "/schedule", "/classes", "/kurse", "/horaire", "/angebot",
                     "/yoga", "/orario", "/class-schedule"]
SLUG_SUFFIXES = ["-yoga", "-studio", "-zurich", "-zuerich", "-bern", "-basel", "-luzern",
                 "-geneve", "-lausanne", "-winterthur"]
SLUG_PREFIX = "yoga-"

# --- schedule text --------------------------------------------------------------
TIME_WORD = r"\b\d{1,2}[:.]\d{2}\b"
DAY_WORD = (
    r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|"
    r"Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|"
    r"Lundi|Mardi|Mercredi|Jeudi|Vendredi|Samedi|Dimanche|"
    r"Lunedì|Martedì|Mercoledì|Giovedì|Venerdì|Sabato|Domenica|"
    r"Mo|Di|Mi|Do|Fr|Sa|So)\b")
TOPIC_WORD = (
    r"\b(?:Vinyasa|Hatha|Yin|Ashtanga|Bikram|Hot Yoga|Power Yoga|"
    r"Kundalini|Restorative|Prenatal|Flow|Pilates|Meditation|"
    r"Yoga Nidra|Jivamukti|Iyengar|Aerial|Dynamic|Slow Flow|"
    r"Mysore|Pranayama|Stretch|Relax|Gentle|Basic|Open Level|"
    r"Beginners?|Anfänger|Morning|Evening|Lunch|Core|Balance)\b")
APPOINTMENT_WORDS = ["yoga", "pilates", "meditation", "breathwork", "vinyasa", "hatha", "yin",
                     "flow", "ashtanga", "kundalini", "stretch"]
LINE_TOPICS = (
    "yoga|vinyasa|hatha|yin|ashtanga|kundalini|flow|pilates|meditation|stretch|power|hot|bikram|"
    "restorative|prenatal|postnatal|nidra|pranayama|mysore|jivamukti|aerial|acro|iyengar|"
    "sivananda|anusara|forrest|rocket|slow|gentle|sanft|dynamic|dynamisch|kurs|class|lektion|"
    "stunde|session")
LINE_NOISE = (
    r"^(?:buchen|book|anmelden|register|sign up|mehr|more|details|info|plätze|spots|frei|"
    r"available|abbrechen|cancel|jetzt|now|login|warenkorb|cart|CHF|EUR|\d+\s*(?:min|€|CHF)|"
    r"cookie|akzeptieren|accept|impressum|datenschutz|agb)$")
TABLE_HEADER_WORDS = ["montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag",
                      "sonntag", "monday", "tuesday", "wednesday", "thursday", "friday",
                      "saturday", "sunday", "zeit", "time", "kurs", "class", "tag", "day"]
LINK_TABLE_WORDS = ["montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag",
                    "sonntag", "monday", "tuesday", "wednesday", "thursday", "friday",
                    "saturday", "sunday", "zeit", "time", "kurs", "class", "lehrer", "teacher"]

# --- tags -----------------------------------------------------------------------
TAG_ROOTS = {
    "vinyasa": ["vinyasa"],
    "hatha": ["hatha"],
    "yin": ["yin"],
    "ashtanga": ["ashtanga", "mysore"],
    "hot": ["hot yoga", "bikram", "hot vinyasa", "inferno hot"],
    "kundalini": ["kundalini"],
    "power": ["power"],
    "aerial": ["aerial", "fly high", "antigravity"],
    "prenatal": ["prenatal", "pränatal", "schwangerschaft", "pregnan", "mama"],
    "restorative": ["restorative"],
}
FEATURE_PATTERNS = {
    "prenatal": ("tags+features", "prenatal|schwanger|postnatal|mama"),
    "seniors": ("tags+features", r"55\+|60\+"),
    "kids": ("tags+features", "kids|kinder|family|kleinkind"),
    "teacher_training": ("features", "teacher training|ryt"),
    "outdoor": ("features", "outdoor|park|sommer"),
}

# --- price estimates --------------------------------------------------------------
TIER_RANGES = {
    "major": {"single": (30, 42), "card_10": (270, 380), "monthly": (180, 280), "trial": (20, 30)},
    "medium": {"single": (25, 35), "card_10": (220, 320), "monthly": (150, 220), "trial": (15, 25)},
    "small": {"single": (22, 30), "card_10": (200, 280), "monthly": (130, 190), "trial": (15, 20)},
}

# --- failure categories, first match wins: (any of, all of, category) ---------------
FAILURE_RULES = [
    (["dynamically", "booking", "widget"], [], "dynamic_platform"),
    ([], ["wix", "404"], "subpages_404"),
    (["403", "blocks"], [], "blocked_403"),
    (["jpg", "image"], [], "image_schedule"),
    (["ssl", "certificate"], [], "ssl_error"),
    (["private", "login"], [], "login_required"),
    (["retreat", "no regular"], [], "no_weekly_classes"),
    (["for sale"], [], "domain_for_sale"),
    (["pause", "break"], [], "on_break"),
    (["national"], [], "national_platform"),
]

# --- access scoring -----------------------------------------------------------------
SCORE_FLAG = 50
GATE_MIN_SECONDS, GATE_MAX_MESSAGE, GATE_MAX_NAME = 3, 5000, 200
DWELL_BUCKETS = [(30, "under-30s"), (60, "30s-1min"), (180, "1-3min"), (300, "3-5min"),
                 (600, "5-10min")]
DWELL_OVER = "over-10min"
