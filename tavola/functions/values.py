"""Word lists, tables and patterns that results depend on.

Everything here is a value, in the order that the rules give it meaning; the
logic that uses it is elsewhere, and every function takes its own values too.
"""

# Logo file name part -> restaurant, first match wins.
RESTAURANTS = [
    ("desperado", "Desperado"),
    ("sirius", "Sirius Club"),
    ("rozsa", "Rózsa Étterem"),
    ("family", "Family Étterem"),
    ("2darvas", "2 Darvas"),
    ("2 serpenyo", "2 Serpenyő"),
    ("csklogo", "CSK Burger"),
    ("gyros", "Gyros Ház"),
    ("fornetti", "Fornetti"),
    ("weber", "Weber"),
    ("kulacs", "Kulács Vendéglő"),
    ("otthon", "Otthon Étterem"),
]
UNKNOWN_RESTAURANT = "Unknown Restaurant"

# Logo names that begin a section.
LOGOS = ["desperado", "sirius", "rozsa", "family", "2darvas", "2serpenyo", "csklogo", "gyros", "fornetti", "weber", "kulacs", "otthon"]

# Paragraphs that are not menu lines.
PARAGRAPH_SKIP = ["étlap", "ajánlat", "nyitva", "zárva", "kártya", "bankkártya", "készpénz", "tel:", "rendelés", "kiszállítás"]

# Words of soups, and of lines that are no dish.
SOUP_WORDS = ["leves", "gulyás", "krémleves", "gombócleves", "csontleves", "gyümölcsleves"]
DEFAULT_SKIP = ["ft", "tel:", "rendelés", "kiszállítás", "nyitva", "zárva"]

# Price windows, inclusive.
REGULAR_PRICE = (1500, 3500)
EXTRA_PRICE = (2000, 4000)

# Scrub steps of a menu line, in order (pattern, replacement).
SCRUB = [
    (r"\s*\+\s*\d+\s*Ft\s*doboz", ""),
    (r"\s*\(\s*\d+\s*Ft\s*\)", ""),
    (r"\s*\d+\s*(?:Ft|ft)(?:\s*[,.].*)?$", ""),
    (r"Tel(?:efon)?:?\s*(?:06|\+36)?[-\s]?\d[\d\s-]+", ""),
    (r"Kiszállítás(?:\s+\w+)*", ""),
    (r"Házhozszállítás(?:\s+\w+)*", ""),
    (r"Menü(?:\s+\w+)*", ""),
    (r"rendelés(?:\s+\w+)*", ""),
    (r"\d{1,2}:\d{2}(?:-\d{1,2}:\d{2})?", ""),
    (r"[,.!?]+$", ""),
    (r"[\(\)]+", ""),
]
SCRUB_TAILS = ["csak második", "extra", "előrendelés", "kiszállítás", "házhozszállítás", "csomagolás", "doboz", "ingyenes", "szép kártya", "otp", "bankkártya", "készpénz", "fizetés", "nyitvatartás", "zárva", "nyitva", "étlap", "ajánlat", "akció", "kedvezmény"]

# Cleaning steps of a dish name, in order (pattern, replacement, ignore case).
CLEAN = [
    (r"^[\"']+|[\"']+$", "", False),
    (r"^[-•\s]+", "", False),
    (r"\s+\d+[\.,]\d+[\.,]?-?\s*$", "", False),
    (r"\b\d+dkg\b", "", False),
    (r"\s*\(\s*\d+[\s,\d]*\)\s*", " ", False),
    (r"\s+\d+[\s,\d]*$", "", False),
    (r"\s*Desszert:.*$", "", True),
    (r"\s*\+\s*sütemény.*$", "", True),
    (r"\s*\+\s*meglepetés.*$", "", True),
    (r"^[A-Z]:\s*", "", False),
    (r"\s*-\s*$", "", False),
]

# Stems of proper nouns, kept with a capital.
PROPER_STEMS = ["bakonyi", "bolognai", "brassói", "csongrádi", "debreceni", "frankfurti", "hortobágyi", "jókai", "kolozsvári", "milánói", "müncheni", "párizsi", "pozsonyi", "szegedi", "újházy", "cordon", "bleu", "holstein", "orly", "stefánia", "pékné", "stroganoff", "wellington", "bbq", "gyros"]

# Noise rules (name, kind, values).  Kinds: contains (any, in lower case), regex
# (on lower case), raw_regex (on the name itself), suffix, exact, all_of, long_any (over 100 characters and any).
NOISE = [
    ("contact", "contains", ["http", "www.", "@", "tel:", "telefon", "+36", "06-"]),
    ("address", "contains", ["utca", "könyök", "kiskunfélegyháza"]),
    ("site", "contains", ["weboldal", "logo", "facebook", "honlap", "kattintson"]),
    ("marketing", "contains", ["korrekt árak", "kedves kiszolgálás", "hétköznapi árak", "változatos ételek", "paypass", "bankkártya", "svédasztal", "korlátlan ételfogyasztás", "hétfőtől-péntekig"]),
    ("menu structure", "contains", ["állandó kínálat", "húsos második helyett", "választható:", "kínálatunk itt", "előfizetve", "mai menü ár", "menü ár", "menekülő menü:", "napi menünk:", "mai menü:", "a mai menekülő menü:", "menekülő menük:"]),
    ("greeting", "contains", ["kínálatunk", "itt találja", "köszönjük", "megértés", "kedves vendég", "vendégeink", "várjuk", "viszontlát", "jó étvágy", "nyitás", "nyitva", "zárva", "áraink", "kellemes", "boldog új", "ünnepeket", "rendelhető", "ételeink", "első:", "második:", "harmadik:", "levesek:", "főételek:", "köretek:", "desszertek:"]),
    ("price token", "regex", [r"\d+\s*ft\b"]),
    ("label", "suffix", [":"]),
    ("time", "raw_regex", [r"^[\d:\s-]+$"]),
    ("literal", "exact", ["felnőtt:", "leves nélkül"]),
    ("standalone price", "regex", [r"^\d+ft$"]),
    ("number", "raw_regex", [r"^\d+$"]),
    ("price list", "all_of", ["tartárral 2.", "rántott szelet"]),
    ("administrative", "exact_trimmed", ["BUÉK", "Mai menü", "Mai menü:", ""]),
    ("composite", "contains", ["menekülő menü:", "csülkös babgulyás a. vagy b.", "crispy chicken nuggets 7db", "cryspy chicken wings", "weber, crispy vagy grillezett"]),
    ("long description", "long_any", ["vagy", "menü", "választható"]),
]

# What makes a name a dish, and what rules that out.
OPTION_WORD = " vagy "
NOT_A_DISH = ["rántott /sajt vagy", "állandó levesek:", "minden nap", ": - ig"]
FOOD_WORDS = ["leves", "gulyás", "pörkölt", "rántott", "sült", "főzelék", "húsleves", "schnitzel", "spagetti", "tészta", "rizs", "burgonya", "saláta", "csirke", "sertés", "marha", "hal", "sajt", "tokány", "paprikás"]
NOT_SIMPLE = [":", "/", "vagy"]

# Letters folded to their base.
FOLD_FROM, FOLD_TO = "áàéèíìóòúùűüőö", "aaeeiioouuuuoo"

# Letters of a token, and tokens without meaning.
TOKEN = "[a-záéíóöőúüű]+"
STOPWORDS = ["vagy", "és", "egy", "a", "az", "van", "volt", "meg", "is"]

# Courses, first match wins.
COURSES = [
    ("leves", ["leves", "krémleves", "gulyásleves", "raguleves", "bableves", "csontleves", "gyümölcsleves", "húsleves", "zöldségleves", "paradicsomleves", "tojásleves", "lebbencsleves", "tarhonyaleves", "palócleves", "brokkoli krémleves", "gombaleves", "babgulyás", "erőleves", "meggyleves", "meggy leves", "almaleves", "grízgaluskaleves", "lebbencs", "karfiol leves", "karfiolleves", "babgulyás", "borsóleves", "lencsegulyás", "burgonyaleves", "kukoricakrémleves", "pacalleves"]),
    ("desszert", ["sütemény", "torta", "palacsinta", "rétes", "máglyarakás", "gombóc", "bukta", "kalács", "krémes", "fagylalt", "tiramisu", "brownie", "mousse", "puding", "strudel"]),
    ("saláta", ["saláta tál", "salátás tál", "saláta tálak"]),
    ("főzelék", ["főzelék"]),
    ("köret", []),
]
DEFAULT_COURSE = "főétel"

# Proteins, all matches count.
PROTEINS = [
    ("csirke", ["csirkemell", "csirkecomb", "csirkeszárny", "csirkemáj", "csirke", "pulykamell", "pulyka", "jérce", "jércemell", "csibe", "szárny", "baromfi"]),
    ("sertés", ["sertés", "sertésszelet", "sertéskaraj", "karaj", "oldalas", "sertésborda", "sertésmáj", "malac", "tarja", "dagadó", "csülök", "sonka", "szalonna", "kolbász", "virsli", "hurka", "disznó", "disznótoros", "bacon"]),
    ("marha", ["marha", "marhahús", "borjú", "gulyás"]),
    ("hal", ["halfilé", "hal ", "pangasius", "lazac", "hekk", "harcsa", "ponty", "tőkehal", "halászlé", "busatörzs"]),
]
VEGETARIAN = ("vegetáriánus", ["sajt", "gomba", "túró", "tojás", "zöldség", "karfiol", "brokkoli", "padlizsán", "cukkini", "lecsó", "bab ", "lencse", "krumpli", "tök"])

# Cooking methods, all matches count.
METHODS = [
    ("rántott", ["rántott", "rántva"]),
    ("sült", ["sült", "sütve", "kisütött"]),
    ("párolt", ["párolt"]),
    ("töltött", ["töltött"]),
    ("grillezett", ["grillezett", "grill", "roston"]),
    ("rakott", ["rakott"]),
    ("főtt", ["főtt", "főzött"]),
    ("pirított", ["pirított"]),
    ("pörkölt", ["pörkölt"]),
    ("tepsis", ["tepsis"]),
    ("bundás", ["bundás"]),
    ("fasírozott", ["fasírozott", "fasírt"]),
    ("párizsi", ["párizsi"]),
    ("bécsi", ["bécsi"]),
    ("milánói", ["milánói"]),
]

# Sides; offered for use, applied nowhere by default.
SIDES = ["burgonya", "rizs", "rizibizi", "galuska", "krokett", "hasábburgonya", "sültburgonya", "törtburgonya", "burgonyapüré", "krumplipüré", "steak burgonya", "bulgur", "tarhonya", "petrezselymes burgonya", "héjában sült burgonya"]

# Seasons and their months.
SEASONS = [("tél", [12, 1, 2]), ("tavasz", [3, 4, 5]), ("nyár", [6, 7, 8]), ("ősz", [9, 10, 11])]

# Page names of the days of a week, from Sunday backwards, and the site's address.
DAY_PAGES = ["vasarnap", "szombat", "pentek", "csutortok", "szerda", "kedd", "hetfo"]

# Curated synonyms (canonical, variants), in order of priority.
SYNONYMS = [
    ("hasábburgonya", ["sült krumpli", "sültburgonya", "steak burgonya", "hasáb burgonya", "pommes"]),
    ("burgonyapüré", ["krumplipüré", "törtburgonya", "tört burgonya"]),
    ("bécsi szelet", ["wiener szelet", "wiener schnitzel"]),
    ("rizibizi", ["rizi-bizi", "rizi bizi"]),
    ("bolognai spagetti", ["bolognai szósz spagetti", "bolognese spagetti", "bolognai"]),
    ("gyümölcsleves", ["hideg gyümölcsleves", "gyümölcs leves", "meggyleves", "meggy leves", "almaleves"]),
    ("csontleves", ["csontleves cérnametélttel", "csontleves cérna metélttel"]),
    ("húsleves", ["húsleves tésztával", "húsleves cérnametélttel", "húsleves csigatésztával"]),
    ("rántott sajt", ["rántott trappista", "rántott trappista sajt"]),
    ("rántott csirkemell", ["rántott jércemell", "rántott jérce mell", "rántott csirke mell"]),
    ("fasírozott", ["fasírt", "házi fasírozott", "házi fasírt"]),
    ("petrezselymes burgonya", ["petrezselymes krumpli", "petrezselymes főtt burgonya"]),
    ("sertéspörkölt", ["sertés pörkölt", "sertéshús pörkölt"]),
    ("csirkepörkölt", ["csirke pörkölt", "csirkemell pörkölt"]),
    ("roston csirkemell", ["grillezett csirkemell", "grill csirkemell"]),
    ("milánói sertésborda", ["milánói borda", "milánói sertés borda"]),
    ("paprikás krumpli", ["paprikáskrumpli", "paprikás burgonya"]),
    ("galuska", ["nokedli", "sztrapacska"]),
    ("savanyúság", ["savanyú káposzta", "savanyúkáposzta", "csemege uborka"]),
    ("túrós csusza", ["túrós tészta", "túróscsusza"]),
    ("káposztás tészta", ["káposzta tészta", "káposztástészta"]),
    ("paradicsomleves", ["paradicsomkrémleves", "paradicsom krémleves", "paradicsom leves"]),
    ("zöldségleves", ["zöldség leves", "vegyes zöldségleves"]),
    ("gyros tál", ["gyros tányér", "gyros"]),
]
