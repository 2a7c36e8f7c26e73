"""Fixed values. They must equal the published ones for results to agree."""

# Stop words removed before counting word frequencies.
STOPWORDS_FREQUENCY = frozenset([
    "de", "la", "el", "en", "y", "a", "los", "las", "con", "que", "se", "del", "un", "una",
    "por", "es", "su", "al", "lo", "muy", "para", "como", "más", "pero", "fue", "todo", "nos",
    "me", "mi", "si", "este", "esta", "también", "hay", "le", "ya", "vez", "bien", "así",
    "lugar", "sin", "ser", "tienen", "tiene", "cuando", "donde", "son", "está", "estaba",
    "les", "sus", "cada", "te", "han", "he", "ha", "era", "no", "ni", "sobre", "entre", "otro",
    "otra", "unos", "unas", "tan", "mas", "porque", "desde", "hasta", "fueron", "hace",
    "mucho", "poco", "solo", "pueden", "puede", "aqui", "ahi", "estos", "estas", "eso", "esa",
    "esos", "esas", "uno", "dos", "tres", "nuestro", "nuestra", "mis", "tu", "realmente",
    "siempre", "aunque", "luego", "antes", "después", "durante", "cuanto", "tanto", "algo",
    "alguien", "nada", "nadie", "todos", "todas", "cual", "siendo", "haber", "tener", "hacer",
    "decir", "ver", "ir", "volver", "llegar", "salir", "quedar", "tuvimos", "fuimos", "vimos",
    "habia", "habian", "estaban", "estamos", "tenemos", "dijo", "dijeron",
])

# The list used by the per-entity term statistics differs by four words.
STOPWORDS_ENTITY = (STOPWORDS_FREQUENCY - {"cual"}) | {"siguiente", "primera", "primer"}

# Complaint categories in order (earlier wins ties) and their keywords.
COMPLAINT_LEXICON = {
    "Servicio lento/malo": ["tardaron", "tardanza", "esperar", "lento", "espera", "tardó"],
    "Precio caro": ["caro", "precio", "costoso", "cobrar", "sobreprecio"],
    "Comida/calidad": ["frío", "fría", "malo", "mala", "calidad", "crudo", "insípido"],
    "Limpieza/higiene": ["sucio", "sucia", "basura", "olor", "mosca", "cucaracha"],
    "Atención/trato": ["grosero", "grosera", "maleducado", "descortés", "arrogante"],
    "Instalaciones": ["viejo", "vieja", "deteriorado", "roto", "pequeño", "estrecho"],
    "Ruido/ambiente": ["ruido", "ruidoso", "música", "bocinas", "molesto"],
    "Engaño/estafa": ["estafa", "engaño", "cobró", "cobran", "mentira"],
    "Espera/colas": ["cola", "fila", "tiempo", "horas", "minutos", "reservación"],
}
NO_COMPLAINT = "Otro"

# Colour of a cluster, by cluster number modulo ten.
CLUSTER_PALETTE = [
    "#E53935", "#1E88E5", "#43A047", "#FB8C00", "#8E24AA",
    "#00ACC1", "#F4511E", "#6D4C41", "#546E7A", "#FFB300",
]

# Weight of a neighbour's vote by its polarity 1..5.
POLARITY_WEIGHTS = [0.2, 0.4, 0.6, 0.8, 1.0]

# The texts a CSV reader takes for a missing value (pandas defaults).
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# How the mixing weight of an entity follows from its reviews.
SIZE_SHARE = 0.6
DIVERSITY_SHARE = 0.4
WIDEST_STD = 1.5
ALPHA_LOW = 0.2
ALPHA_HIGH = 0.95

# How an answer is shown.
QUERY_MIN_LENGTH = 3
QUERY_ERROR = "query inválido"
BAR_START = 0.85
ALPHA_CONTENT = 0.7
ALPHA_COLLABORATIVE = 0.4
LABEL_CONTENT = "más contenido"
LABEL_COLLABORATIVE = "más colaborativo"
LABEL_BALANCED = "equilibrado"

# Sizes of the marks on the map.
MARK_TOP = 220
MARK_OTHER = 90
MARK_QUERY = 450
HIGHLIGHT_FIRST = 500
HIGHLIGHT_STEP = 70
