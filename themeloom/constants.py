"""Word lists, lookup tables, patterns and default parameters.

Everything here is data that decides results.  All of it is only a *default*: the operators take
word lists, taxonomies, phrase forms and hosts as arguments, so the same jobs run on any language.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------------
# Labels, statuses, thresholds
# --------------------------------------------------------------------------------------------
OTHER_LABEL = "Diğer"
UNCERTAIN_LABEL = "Belirsiz"
JOINT_SEPARATOR = " > "

STATUS_OK = "ok"
STATUS_UNCERTAIN = "uncertain"
STATUS_OUT_OF_SCOPE = "out_of_scope"
STATUS_EMPTY = "empty"
STATUS_OFFLINE = "offline"
STATUS_ERROR = "error"

SEED = 42
TEST_SIZE = 0.15
VAL_SIZE = 0.15
UNSEEN_OOD_FRACTION = 0.35
EXPECTED_CARDS = 37_278

NB_ALPHA = 0.001
SOFTMAX_L2 = 1e-6
SOFTMAX_MAX_EPOCHS = 30
EARLY_STOP_PATIENCE = 3
CONFIDENCE_GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(15))
MODEL_VERSION = "2.0.0"
MODEL_FORMAT_VERSION = 1

MAX_INPUT_CHARS = 5_000
MAX_SUBTOPICS = 3
SUBTOPIC_MIN_SCORE = 0.15
RELATED_TOPIC_MIN_SCORE = 0.20
KEYWORD_LIMIT = 4
KEYWORD_MIN_WEIGHT = 0.30

DECAY = 0.7
TOPIC_MIN_SHARE = 0.15
MAX_THEME_TOPICS = 3
SUBTOPIC_FOCUS_SHARE = 0.5

MAX_QUERY_KEYWORDS = 2
LONG_CORE_WORDS = 3
MAX_QUERY_CHARS = 100
MIN_STEM_CHARS = 4

MAX_RESULTS = 3
MAX_TITLE_CHARS = 150
MAX_SUMMARY_CHARS = 400
MAX_URL_CHARS = 2048
MISSING_RESULT_INDEX = 1_000
CACHE_TTL_HOURS = 24
OFFLINE_COOLDOWN_SECONDS = 120
ALLOWED_HOSTS = ("wikipedia.org", "duckduckgo.com")

NEAR_DUPLICATE_COSINE = 0.9
EXTERNAL_MIN_WORDS = 6
EXTERNAL_MAX_WORDS = 40
EXTERNAL_SAMPLE_PER_SOURCE = 400

CARD_KEYS = ("kategori", "kelime", "aciklama")

# --------------------------------------------------------------------------------------------
# Control messages
# --------------------------------------------------------------------------------------------
EXIT_COMMANDS = ("çıkış", "cikis", "q", "quit", "exit")
HISTORY_COMMANDS = ("geçmiş", "gecmis")
RESET_COMMANDS = ("sıfırla", "sifirla")
HELP_COMMANDS = ("yardım", "yardim", "help", "?")

# --------------------------------------------------------------------------------------------
# Stop words
# --------------------------------------------------------------------------------------------
STOPWORDS = tuple(
    """
    acaba ama ancak artık aslında az bana bazı belki ben beni benim bile bir biraz birkaç
    birçok biri birşey biz bize bizi bizim bu buna bunda bundan bunlar bunları bunu bunun
    burada çok çünkü da daha dahi de defa değil diye diğer en gibi göre hem hep hepsi her
    herhangi hiç için ile ise işte kadar ki kim kime kimi mı mi mu mü nasıl ne neden nerede
    nereye niçin niye o olan olarak oldu olduğu olmak olup on ona onda ondan onlar onları
    onu onun öyle pek sanki şey siz size sizi sizin şu şuna şunda şundan şunu tüm ve veya
    ya yani yine yoksa zaten ayrıca yalnız yalnızca sadece önce sonra şimdi var yok olur
    olması ettiği eden etmek etti üzere karşı arasında başka böyle
    """.split()
)

# --------------------------------------------------------------------------------------------
# Taxonomy, category -> (general topic, subtopic)
# --------------------------------------------------------------------------------------------
GENERAL_TOPICS = (
    "Fizik", "Kimya", "Biyoloji", "Teknoloji", "Bilim", "Kitaplar", "Spor", "Tarih",
)
CATEGORY_TOPICS = {
    "kuantum": ("Fizik", "Kuantum Mekaniği"),
    "termodinamik": ("Fizik", "Termodinamik"),
    "optik": ("Fizik", "Optik"),
    "akustik": ("Fizik", "Akustik"),
    "astronomi": ("Fizik", "Astrofizik ve Astronomi"),
    "kimya": ("Kimya", "Genel Kimya"),
    "metalurji": ("Kimya", "Metalurji ve Malzeme"),
    "genetik": ("Biyoloji", "Genetik"),
    "ekoloji": ("Biyoloji", "Ekoloji"),
    "mikrobiyoloji": ("Biyoloji", "Mikrobiyoloji"),
    "botanik": ("Biyoloji", "Botanik"),
    "zooloji": ("Biyoloji", "Zooloji"),
    "kuslar": ("Biyoloji", "Zooloji"),
    "denizcanlilari": ("Biyoloji", "Zooloji"),
    "paleontoloji": ("Biyoloji", "Evrim ve Paleontoloji"),
    "yapayzeka": ("Teknoloji", "Yapay Zeka"),
    "donanim": ("Teknoloji", "Donanım"),
    "algoritmalar": ("Teknoloji", "Yazılım ve Algoritmalar"),
    "siber": ("Teknoloji", "Siber Güvenlik"),
    "robotik": ("Teknoloji", "Robotik"),
    "telekomunikasyon": ("Teknoloji", "Telekomünikasyon"),
    "nanoteknoloji": ("Teknoloji", "Nanoteknoloji"),
    "epistemoloji": ("Bilim", "Bilim Felsefesi ve Yöntem"),
    "edebiyat": ("Kitaplar", "Edebiyat, Roman ve Şiir"),
    "turkhalkedebiyati": ("Kitaplar", "Türk Halk Edebiyatı"),
    "masallar": ("Kitaplar", "Masallar"),
    "cizgiroman": ("Kitaplar", "Çizgi Roman"),
    "futbol": ("Spor", "Futbol"),
    "basketbol": ("Spor", "Basketbol"),
    "voleybol": ("Spor", "Voleybol"),
    "tenis": ("Spor", "Tenis"),
    "atletizm": ("Spor", "Atletizm ve Olimpiyatlar"),
    "motor_sporlari": ("Spor", "Motor Sporları"),
    "dovus": ("Spor", "Dövüş Sporları"),
    "binicilik": ("Spor", "Doğa ve Binicilik Sporları"),
    "dagcilik": ("Spor", "Doğa ve Binicilik Sporları"),
    "osmanli": ("Tarih", "Osmanlı Tarihi"),
    "cumhuriyettarihi": ("Tarih", "Cumhuriyet Tarihi"),
    "savas": ("Tarih", "Savaşlar ve Askeri Tarih"),
    "arkeoloji": ("Tarih", "Antik Çağ ve Arkeoloji"),
    "epigrafi": ("Tarih", "Antik Çağ ve Arkeoloji"),
}
EXCLUDED_CATEGORIES = (
    "anatomi", "cerrahi", "dermatoloji", "farmakoloji", "immunoloji", "noroloji",
    "patoloji", "pediyatri", "epidemiyoloji", "psikiyatri", "saglikliyasam",
    "astronotik", "havacilik", "mekatronik", "jeoloji", "jeomorfoloji", "meteoroloji",
    "osinografi", "orman", "vahsidoga", "felsefe", "mantik", "mitoloji", "monarsi",
    "numizmatik", "tiyatro", "internethayati", "sosyalmedya", "videooyunlari", "kripto",
    "dalgiclik",
)
# One category is split by a pattern on the term before the table is looked up.
OVERRIDE_CATEGORY = "kuantum"
OVERRIDE_PATTERN = (
    "kübit|qubit|kuantum (bilgisayar|işlemci|kapı|devre|algoritma|bellek|hata|hacmi|hızı|"
    "üstünlüğü)|topolojik (kuantum )?bilgisayar|hadamard kapısı|cnot|pauli kapısı|"
    "faz kapısı|yüzey kodu|transmon|hata düzeltme|bloch küresi|kuantum gürültüsünü"
)
OVERRIDE_TOPIC = ("Teknoloji", "Kuantum Bilgisayarlar")

SEED_CATEGORY = "taksonomi"
SEED_SOURCE = "taxonomy"

# --------------------------------------------------------------------------------------------
# Topic -> (role, noun, compound, adjective) for theme phrases
# --------------------------------------------------------------------------------------------
TOPIC_FORMS = {
    "Kitaplar": ("medium", "kitaplar", "kitap", "edebi"),
    "Bilim": ("qualifier", "bilim", "bilim", "bilimsel"),
    "Fizik": ("domain", "fizik", "fizik", "fiziksel"),
    "Kimya": ("domain", "kimya", "kimya", "kimyasal"),
    "Biyoloji": ("domain", "biyoloji", "biyoloji", "biyolojik"),
    "Teknoloji": ("domain", "teknoloji", "teknoloji", "teknolojik"),
    "Spor": ("domain", "spor", "spor", "sportif"),
    "Tarih": ("domain", "tarih", "tarih", "tarihi"),
}
MEDIUM_HEADS = {"Kitaplar": "kitapları"}
PHRASE_AND = " ve "
PHRASE_ABOUT = " hakkında "
PHRASE_FIELD = " alanında "
PHRASE_RESEARCH = " araştırmalar"

# --------------------------------------------------------------------------------------------
# Query building
# --------------------------------------------------------------------------------------------
FILLER_WORDS = ("alanında", "ve")
FINITE_VERB_PATTERN = (
    "(?:[ıiuü]yor(?:um|sun|uz|lar)?|(?:d|(?<=[çfhkpsşt])t)[ıiuü](?:m|n|k|nız|niz|lar|ler)?|"
    "[mn][ıiuü]ş(?:[ıiuü]m|lar|ler)?|[ae]c[ae]k(?:[ıi]m|lar|ler)?)$"
)
CASE_SUFFIX_PATTERN = "(?:y?l[ae]|[dt][ae]n|[dt][ae])$"
FINITE_VERB_MIN_CHARS = 5

# --------------------------------------------------------------------------------------------
# Text patterns.  Java's \w, \d and \b only know ASCII, hence the explicit class.
# --------------------------------------------------------------------------------------------
WORD_CLASS = r"[\p{L}\p{N}_]"
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = r"(?i)(?:https?://\S+|www\.\S+)"
TOKEN_PATTERN = "[a-zçğıöşüâîû]+"
SENTENCE_BREAK_PATTERN = r"(?<=[.!?])\s+"
MOJIBAKE_MARKERS = ("Ã", "Ä", "Å")
