"""Fixed values that must equal the reference's for results to match.

Every literal the reference's behaviour depends on lives here, in its
natural order, as plain text: rates, product names, vocabularies, text
prefixes and thresholds. Nothing else in the package hard-codes them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: identifier formats and batch bounds
# ---------------------------------------------------------------------------
CEDULA_PATTERN = r"\A[0-9]{5,11}\z"
SYNTHETIC_ID_PATTERN = r"\AP[0-9]{1,11}\z"
MIN_BATCH_SIZE = 10
MAX_BATCH_SIZE = 2000
MAX_RAW_IDS = 10000

# ---------------------------------------------------------------------------
# FIXED VALUES: rule-based offer engine
# ---------------------------------------------------------------------------
RATES_BY_CATEGORY = {"A": 0.145, "B": 0.165, "C": 0.185}
DEFAULT_RATE_CATEGORY = "C"
DEFAULT_TERM_MONTHS = 36
INCOME_SHARE_FOR_INSTALMENT = 0.30
DEFAULT_CAPACITY_PCT = 30.0
DEFAULT_AGE = 40
NIGHT_WINDOW_BELOW_AGE = 40
DECLINE_MORA = "90_MAS_DIAS"
DEFAULT_TRIGGER = "inmediato"
NO_INTEREST_TEXT = "tu perfil financiero"

# Interest -> product, in rule priority order (first match wins).
INTEREST_RULES = [
    ("educacion", "educativo", "Crédito Educativo"),
    ("consolidacion", "compra_cartera", "Compra de Cartera"),
    ("vivienda", "hipotecario", "Crédito Hipotecario"),
]
DEFAULT_PRODUCT = ("libre_inversion", "Crédito de Libre Inversión")

# Channels that may carry a generated (non-template) text.
GENERATED_TEXT_CHANNELS = ["whatsapp", "sms", "email"]

# ---------------------------------------------------------------------------
# FIXED VALUES: enumerations (CHECK constraints of the stored tables)
# ---------------------------------------------------------------------------
CATEGORIES = ["A", "B", "C", "D"]
MORA_LEVELS = ["0_DIAS", "30_DIAS", "60_DIAS", "90_MAS_DIAS"]
BATCH_STATUSES = ["queued", "processing", "completed", "failed"]
RESULT_STATUSES = ["processed", "person_not_found", "no_offer", "error"]
CHANNELS = ["whatsapp", "sms", "email", "app", "callcenter", "branch"]
CONTACT_WINDOWS = ["morning", "midday", "afternoon", "night"]
MESSAGE_SOURCES = ["llm", "template"]
MESSAGE_STATUSES = ["scheduled", "pending", "sent"]
LABEL_COLUMNS = [
    "area_trabajo",
    "intereses",
    "preferencias",
    "momentos_clave",
    "composicion_familiar",
    "historial_creditos",
]
# Allowed batch status moves.
STATUS_MOVES = [("queued", "processing"), ("processing", "completed"), ("processing", "failed")]

# ---------------------------------------------------------------------------
# FIXED VALUES: encoder column groups
# ---------------------------------------------------------------------------
NUMERIC_COLS = [
    "edad",
    "ingresos",
    "score_datacredito",
    "num_creditos_activos",
    "deuda_total_acumulada_cop",
    "cuota_mensual_total_cop",
    "capacidad_endeudamiento_disponible_pct",
]
ONEHOT_COLS = ["categoria_afiliacion"]
ORDINAL_COLS = ["mora_maxima_historica"]
ORDINAL_ORDER = ["0_DIAS", "30_DIAS", "60_DIAS", "90_MAS_DIAS"]
MULTILABEL_COLS = LABEL_COLUMNS
EXCLUDED_COLS = [
    "cedula",
    "nombre",
    "correo",
    "direccion",
    "fecha_nacimiento",
    "telefono",
    "consent_whatsapp",
    "consent_email",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: model feature contract (25 numeric + 6 categorical)
# ---------------------------------------------------------------------------
NUMERICAL_FEATURES = [
    "age", "income", "tenure_months", "job_tenure_months", "dependents",
    "internal_score", "debt_ratio", "subsidy_usage_12m", "supermarket_usage_12m",
    "recreation_usage_12m", "education_usage_12m", "services_usage_index",
    "months_since_last_credit", "current_delinquency", "active_credit",
    "has_mortgage", "digital_affinity", "months_since_event", "education_interest",
    "housing_interest", "consolidation_interest", "tax_interest", "tourism_interest",
    "tech_interest", "health_interest",
]
CATEGORICAL_FEATURES = ["category", "contract_type", "company_size", "city", "life_event", "job_sector"]
PRODUCT_TARGETS = {
    "revolving_line": "tomo_cupo_rotativo",
    "personal_loan": "tomo_libre_inversion",
    "mortgage": "tomo_hipotecario",
    "education": "tomo_educativo",
    "debt_consolidation": "tomo_compra_cartera",
    "womens_credit": "tomo_mujer",
    "tax_insurance": "tomo_impuestos_seguros",
    "complementary_mortgage": "tomo_complementario_hipotecario",
}
DEFAULT_TARGET = "default_12m"
OOV_THRESHOLD = 0.20

# ---------------------------------------------------------------------------
# FIXED VALUES: product catalog (product_id, margin, rates A/B/C, term,
# min/max amount in minimum wages, allowed categories, min/max age,
# min internal score, requires no delinquency, gender, prerequisite)
# ---------------------------------------------------------------------------
PRODUCT_CATALOG = [
    ("revolving_line", 0.12, (0.14, 0.16, 0.18), 36, 1.0, 10.0, ["A", "B", "C"], 18, 69, 0.0, False, None, None),
    ("personal_loan", 0.10, (0.13, 0.15, 0.17), 36, 1.0, 150.0, ["A", "B", "C"], 18, 69, 0.0, False, None, None),
    ("mortgage", 0.05, (0.09, 0.10, 0.11), 180, 50.0, 500.0, ["A", "B"], 18, 65, 0.0, False, None, None),
    ("education", 0.06, (0.10, 0.12, 0.14), 36, 1.0, 50.0, ["A", "B", "C"], 18, 69, 0.0, False, None, None),
    ("debt_consolidation", 0.07, (0.11, 0.13, 0.15), 36, 1.0, 100.0, ["A", "B", "C"], 18, 69, 0.0, False, None, None),
    ("womens_credit", 0.09, (0.12, 0.14, 0.16), 36, 1.0, 15.0, ["A", "B", "C"], 18, 69, 0.0, False, "Female", None),
    ("tax_insurance", 0.11, (0.13, 0.15, 0.17), 11, 0.5, 10.0, ["A", "B", "C"], 18, 69, 0.0, False, None, None),
    ("complementary_mortgage", 0.05, (0.09, 0.10, 0.11), 36, 5.0, 100.0, ["A", "B", "C"], 18, 69, 0.0, False, None, "mortgage"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: risk policy and money
# ---------------------------------------------------------------------------
PD_LOW_RISK = 0.10
PD_HIGH_RISK = 0.20
LGD = 0.45
AMOUNT_REDUCTION_FACTOR = 0.50
MIN_EV_THRESHOLD = 0.0
SMMLV_COP = 1423500
MAX_AMOUNT_INCOME_MULTIPLE = 3.0
LOW_INCOME_AMOUNT_CAP = 1500000.0
DISPOSABLE_INCOME_SHARE = 0.30
TENURE_MONTHS_INDEFINITE = 2
TENURE_MONTHS_OTHER = 6

# ---------------------------------------------------------------------------
# FIXED VALUES: channel scorer
# ---------------------------------------------------------------------------
BAYES_ALPHA = 50
AFFINITY_HIGH = 70
AFFINITY_MEDIUM = 45
SEASONALITY_RATIO = 1.3
LIFE_EVENT_MONTHS = 12
NEW_MEMBER_MONTHS = 3
# "recently cleared credit" has no number in the specification: a quarter
RECENT_CREDIT_MONTHS = 3

# ---------------------------------------------------------------------------
# FIXED VALUES: generated-text cleaning (prefixes checked in this order)
# ---------------------------------------------------------------------------
COMMON_PREFIXES = [
    "Mensaje:",
    "Mensaje personalizado:",
    "Aquí está el mensaje:",
    "Aquí tienes el mensaje:",
    "Claro, aquí tienes:",
    "¡Claro!",
    "Por supuesto:",
    "Mensaje de WhatsApp:",
    "Mensaje SMS:",
    "Correo electrónico:",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: metrics
# ---------------------------------------------------------------------------
ECE_BINS = 10
LIFT_DECILES = 10
FAIRNESS_TOP_K_PCT = 0.20
FOUR_FIFTHS = 0.80
SPLIT_SEED = 42
SPLIT_FRACTIONS = (0.6, 0.2, 0.2)
SAMPLE_SIZE = 1000

# ---------------------------------------------------------------------------
# FIXED VALUES: trigger phrases of each conversation topic
# ---------------------------------------------------------------------------
TOPIC_PHRASES = {
    "thank_you": ["gracias", "gracias a ti", "gracias a usted", "muchas gracias", "grcs"],
    "goodbye": [
        "Adiós", "Hasta pronto", "Hasta otra", "¡Adiós!", "No, gracias. Adiós.", "No, gracias a ti, adiós.",
        "No, gracias a usted, adiós.", "¡Hasta luego!",
    ],
    "escalate": [
        "Hablar con un agente", "Hablar con una persona", "Hablar con alguien", "Devolver llamada",
        "Llamar al servicio al cliente", "Llámeme, por favor", "Llámame, por favor", "Llamar a soporte",
        "Llamar a soporte técnico", "Llamar al soporte técnico", "¿Puede llamarme un agente?", "¿Puedo llamar?",
        "¿Puedo contactar con otra persona?", "¿Puedo ponerme en contacto con otra persona?",
        "¿Puedo obtener soporte de un agente real?", "¿Me pueden transferir la llamada a una persona?",
        "¿Me pueden llamar?", "¿Me puede llamar un representante?", "¿Puedo programar una llamada?",
        "¿Puedo hablar con un representante?", "¿Puedo hablar con un humano?", "¿Puedo hablar con un asistente humano?",
        "¿Puede llamarme alguien?", "Charlar con un humano", "Charlar con un representante", "Charlar con un agente",
        "Charlar con alguien", "Conéctame con un agente por chat", "Conécteme con un agente por chat",
        "Conectarme con un agente por chat", "Conéctame con una persona", "Conécteme con una persona",
        "Conectarme con una persona", "¿Me podría contactar alguien por teléfono?", "Agente de atención al cliente",
        "Representante del cliente", "Servicio de atención al cliente", "Necesito hablar con un responsable",
        "Necesito que un responsable se ponga en contacto conmigo", "Necesito atención al cliente",
        "Necesito ayuda de una persona", "Necesito hablar con un agente por chat", "Necesito hablar con un especialista",
        "Quiero hablar con el servicio de atención al cliente", "Quiero continuar con el soporte por chat",
        "Quiero hablar con un consultor", "Quiero hablar con un técnico por chat", "Me gustaría hablar con un asociado",
        "Me gustaría hablar con un técnico", "Me gustaría hablar con un miembro del soporte técnico",
        "Me gustaría hablar con alguien de soporte técnico",
    ],
    "start_over": [
        "empecemos de nuevo", "vamos a empezar de nuevo", "comencemos de nuevo", "volver a empezar", "volver a comenzar",
        "empezar de nuevo", "comenzar de nuevo", "reiniciar", "reanudar",
    ],
    "soat": [
        "soat information", "what is soat", "soat requirements", "how to get soat", "soat renewal", "soat cost",
        "buy soat online", "is my soat valid", "soat insurance details", "where can I purchase soat",
    ],
    "bicycles": [
        "información seguro bicicletas Colsubsidio", "cotización seguro patinetas Colsubsidio",
        "quiero asegurar mi bicicleta con Colsubsidio", "precio seguro para patineta en Colsubsidio",
        "cómo funciona el seguro de bicicletas Colsubsidio", "beneficios del seguro de patinetas Colsubsidio",
        "solicitar cotización de seguro para bicicleta y patineta", "seguro para bicicletas y patinetas en Colsubsidio",
        "protección para mi bicicleta con Colsubsidio",
    ],
    "cars": [
        "información de seguro para carros", "cotización de seguro de auto", "quiero asegurar mi carro",
        "precio del seguro para autos", "cómo obtener un seguro para mi coche", "cuánto cuesta el seguro de carro",
        "necesito información sobre seguros automotrices", "solicitar cotización de seguro vehicular", "asegurar mi vehículo",
    ],
    "cars_fund": [
        "información de seguro para carros Colsubsidio", "cotización de seguro de auto Colsubsidio",
        "quiero asegurar mi carro con Colsubsidio", "precio del seguro para autos Colsubsidio",
        "cómo obtener un seguro de carro en Colsubsidio", "detalles del seguro automotriz Colsubsidio",
        "solicitar cotización de seguro vehicular Colsubsidio", "beneficios del seguro para carros en Colsubsidio",
        "opciones de seguros para autos con Colsubsidio",
    ],
    "motorbikes": [
        "información seguro moto Colsubsidio", "cotización seguro para motos Colsubsidio",
        "quiero asegurar mi moto con Colsubsidio", "precio seguro de moto Colsubsidio",
        "cómo obtener seguro para motos en Colsubsidio", "detalles del seguro de motos Colsubsidio",
        "solicitar cotización de seguro moto Colsubsidio", "beneficios del seguro para motos en Colsubsidio",
        "qué cubre el seguro de moto Colsubsidio",
    ],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: insurance needs (whole words, in priority order; the last
# field is a complement that follows the product)
# ---------------------------------------------------------------------------
INSURANCE_RULES = [
    (["bicicleta", "bicicletas", "patineta", "patinetas", "scooter", "scooters"], [], "Seguro para Bicicleta, Patineta o Scooter", None),
    (["soat", "seguro obligatorio"], [], "SOAT", None),
    (["carro", "carros"], [], "Seguro para Carro", None),
    (["moto", "motos"], [], "Asistencia para Moto", None),
    (["perro", "gato", "mascota", "mascotas"], ["enferma", "enferman", "enfermo", "enfermedad", "enfermedades"], "Medicina Prepagada para Mascotas", None),
    (["veterinario", "veterinaria", "veterinarios", "veterinarias"], [], "Asistencia Veterinaria para Mascotas", None),
    (["mascota", "mascotas"], [], "Seguro para Mascotas", "Medicina Prepagada para Mascotas"),
]
MAX_SUGGESTIONS = 2
UNKNOWN_TURNS_TO_ESCALATE = 3
