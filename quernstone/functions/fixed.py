"""Domain constants that results depend on."""

# Phases of the conflict: first day after each, oldest first; after the last it is "ongoing".
PHASES = (
    ("1950-01-01", "nakba-1948"),
    ("1968-01-01", "naksa-1967"),
    ("1994-01-01", "first-intifada"),
    ("2001-01-01", "oslo-period"),
    ("2006-01-01", "second-intifada"),
    ("2009-01-19", "gaza-2008-2009"),
    ("2012-12-01", "gaza-2012"),
    ("2014-09-01", "gaza-2014"),
    ("2021-06-01", "gaza-2021"),
    ("2023-10-07", "pre-escalation-2023"),
    ("2025-01-20", "gaza-war-2023"),
)
LAST_PHASE = "ongoing"

# The coarse phases: first day after each; then "ongoing-conflict".
ESCALATION_PHASES = (("2023-10-07", "pre-escalation"), ("2024-01-01", "active-conflict"))
LAST_ESCALATION_PHASE = "ongoing-conflict"

# Synonyms of event types; anything else stays as it is.
EVENT_TYPES = {
    "airstrike": "airstrike",
    "air strike": "airstrike",
    "aerial bombardment": "airstrike",
    "bombing": "airstrike",
    "artillery": "artillery",
    "shelling": "artillery",
    "mortar": "artillery",
    "shooting": "shooting",
    "gunfire": "shooting",
    "small arms": "shooting",
    "raid": "raid",
    "incursion": "raid",
    "military operation": "raid",
    "explosion": "explosion",
    "blast": "explosion",
    "ied": "explosion",
    "clash": "armed clash",
    "armed clash": "armed clash",
    "firefight": "armed clash",
    "protest": "protest",
    "demonstration": "protest",
}

# Factors of the severity index by event type; 1.0 for others.
EVENT_FACTORS = {
    "airstrike": 1.5,
    "artillery": 1.3,
    "explosion": 1.4,
    "armed clash": 1.2,
    "shooting": 1.0,
    "raid": 0.8,
    "protest": 0.5,
}

# Parts of organisations' names by the accuracy of their data; 0.8 for others.
OFFICIAL_ORGANISATIONS = ("un", "who", "world bank", "ocha", "pcbs", "unrwa")
RIGHTS_ORGANISATIONS = ("btselem", "amnesty", "hrw", "tech4palestine")

# Valid coordinates of records.
LATITUDES = (29.0, 34.0)
LONGITUDES = (33.0, 36.5)

# Base confidence and rank of a fact's source; (0.30, 0) for others.
FACT_SOURCES = {
    "human_local": (0.98, 6),
    "live_feed": (0.90, 5),
    "ocha_hdx": (0.85, 4),
    "rights_doc": (0.75, 3),
    "osm": (0.70, 2),
    "model_inferred": (0.30, 1),
}

# Half-lives of facts in days; 120 for others.
FACT_HALF_LIVES = {
    "node_exists_permanent": 700.0,
    "node_exists_intermittent": 120.0,
    "edge_road_exists": 700.0,
    "edge_permission": 700.0,
    "edge_gating": 30.0,
    "live_status": 1.5,
}

# Minutes that a live status adds to a road; closed roads are not passable.
STATUS_PENALTIES = {
    "open": 0.0,
    "clear": 0.0,
    "inspection": 10.0,
    "police": 10.0,
    "slow": 12.0,
    "partial": 8.0,
    "unknown": 8.0,
    "congested": 20.0,
    "crisis": 28.0,
    "idf": 26.0,
}

# Statuses from the least to the most severe; others count as unknown.
STATUS_SEVERITY = (
    "open", "clear", "partial", "unknown", "inspection", "police", "slow", "congested", "idf", "crisis", "closed",
)

# How road statuses are written in messages.
STATUS_WORDS = {
    "سالك": "open", "سالكه": "open", "سالكة": "open", "سالكين": "open", "مفتوح": "open", "مفتوحه": "open",
    "مفتوحة": "open", "مفتوحين": "open", "فاتح": "open", "فاتحه": "open", "فاتحة": "open", "فتح": "open",
    "مغلق": "closed", "مغلقه": "closed", "مغلقة": "closed", "مغلقين": "closed", "مقفل": "closed", "مقفله": "closed",
    "مسكر": "closed", "مسكره": "closed", "موقوف": "closed", "موقف": "closed", "مسدود": "closed", "مسدوده": "closed",
    "زحمه": "congested", "زحمة": "congested", "ازمه": "congested", "ازمة": "congested", "أزمة": "congested", "مزحوم": "congested",
    "ضاغط": "congested", "ضغط": "congested", "مزدحم": "congested", "مزدحمه": "congested", "ازدحام": "congested",
    "بطيء": "slow", "بطئ": "slow", "بطيئ": "slow",
    "جيش": "idf", "الجيش": "idf", "عسكر": "idf", "مداهمه": "idf", "مداهمة": "idf", "تواجد": "idf", "حاجز": "idf", "سيارات": "idf",
    "شرطه": "police", "شرطة": "police", "دوريه": "police", "دورية": "police",
    "تفتيش": "inspection",
}
STATUS_PHRASES = {
    "فيه جيش": "idf", "عليه جيش": "idf", "معهم جيش": "idf", "فيه عسكر": "idf", "حاجز طيار": "idf", "نصب حاجز": "idf", "عمل حاجز": "idf",
    "فيه شرطه": "police", "عليه شرطه": "police", "سياره شرطه": "police", "سيارة شرطة": "police", "دوريه شرطه": "police", "دورية شرطة": "police",
    "تفتيش هويات": "inspection", "تفتيش دقيق": "inspection",
    "فيه ضغط": "congested", "فيه زحمه": "congested", "فيه زحمة": "congested",
    "مش سالك": "closed", "مش فاتح": "closed", "غير سالك": "closed",
}
STATUS_EMOJIS = {
    "✅": "open", "🟢": "open", "🔴": "closed", "🚫": "closed", "⛔": "closed", "❌": "closed", "🛑": "closed",
    "🟠": "congested", "🟡": "slow", "🟣": "idf", "🚔": "police",
}
DIRECTION_WORDS = {
    "الداخل": "inbound", "للداخل": "inbound", "لداخل": "inbound", "داخل": "inbound", "دخول": "inbound", "للدخول": "inbound",
    "الخارج": "outbound", "للخارج": "outbound", "لخارج": "outbound", "خارج": "outbound", "خروج": "outbound", "للخروج": "outbound",
    "بالاتجاهين": "both", "اتجاهين": "both", "الاتجاهين": "both", "باتجاهين": "both", "بالإتجاهين": "both",
}

# Words in messages that are no part of a place's name.
FILLER_WORDS = (
    "الحمدلله", "الحمد", "لله", "الله", "يعينكم", "يعطيكم", "العافيه", "العافية", "شباب", "يا", "اخوان", "اخواني", "ياشباب", "ياجماعه",
    "ياجماعة", "جماعه", "جماعة", "مشكورين", "شكرا", "يسلمو", "كيف", "شو", "هل", "وين", "ايش", "حاجز", "الحاجز", "حالياً", "حاليا",
    "هلا", "هلأ", "الان", "الآن", "تقريبا", "تقريباً", "اليوم", "صباح", "الخير", "مساء", "في", "على", "من", "عند", "الى", "إلى",
    "الفندق", "فندق", "نظيف", "نظيفه", "نظيفة", "نظيفين", "هادئ", "هادئه", "هادئة", "هادئين", "طبيعي", "طبيعيه", "طبيعية",
    "ومفتوح", "ومفتوحه", "ومفتوحة",
)
GREETINGS = ("صباح الخير", "يسعد صباحك", "يسعد اوقاتك", "يسعد مساك", "السلام عليكم", "الله يسعد صباحك", "اخوي", "اخي", "مشرفنا")
PLACE_KINDS = ("بوابه", "بوابات", "شرطه", "اشارات", "اشاره", "دوار", "جسر", "مدخل", "التفافي", "نفق", "حاجز", "معبر")

# Lines that are headers or speak of all places.
HEADER_PATTERNS = (
    r"^[#\-_=*]+", "^الضفة", "^منطقة", "^محافظة", "^جنوب", "^شمال", "^وسط", "^أولاً", "^ثانياً", "^ملاحظة",
    r"كافه\s+حواجز", r"كافة\s+حواجز", r"جميع\s+حواجز", r"باقي\s+حواجز", r"كامل\s+خط", r"^احوال\s+طرق", r"^احوال\s+الطرق",
)

# Base of an area's score by its status.
AREA_BASE = {"calm": 0, "restricted": 2, "military_presence": 5, "lockdown": 8}

# Gate statuses of a route from the least to the most severe.
ROUTE_SEVERITY = ("open", "partial", "unknown", "inspection", "slow", "congested", "idf", "crisis")
