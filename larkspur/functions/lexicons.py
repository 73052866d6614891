"""Word lists, lookup tables and constants that results depend on."""

# Concept lexicon, English (fixed values).
CONCEPTS_EN = {
    "DYSPNEA": ["dyspnea", "shortness of breath", "breathlessness", "difficulty breathing"],
    "CHEST_PAIN": ["chest pain", "chest tightness", "chest pressure", "angina"],
    "FEVER": ["fever", "high temperature", "hyperthermia", "pyrexia"],
    "TACHYCARDIA": ["tachycardia", "high heart rate", "fast heart rate", "palpitations"],
    "HYPERTENSION": ["hypertension", "high blood pressure"],
    "DIABETES": ["diabetes", "diabetes mellitus"],
    "HYPOXEMIA": ["hypoxemia", "low oxygen saturation", "low spo2", "hypoxia"],
}
# Concept lexicon, Spanish, without accents (fixed values).
CONCEPTS_ES = {
    "DISNEA": ["disnea", "dificultad respiratoria", "falta de aire", "ahogo"],
    "DOLOR_TORACICO": ["dolor toracico", "opresion toracica", "dolor en el pecho", "pecho opresivo"],
    "FIEBRE": ["fiebre", "temperatura alta", "hipertermia"],
    "TAQUICARDIA": ["taquicardia", "frecuencia cardiaca elevada", "palpitaciones"],
    "HIPERTENSION": ["hipertension", "presion arterial alta"],
    "DIABETES": ["diabetes", "diabetes mellitus"],
    "HIPOXEMIA": ["hipoxemia", "saturacion baja", "spo2 baja", "saturacion de oxigeno baja"],
}
# Aliases and display names for symptom coverage (fixed values).
COVERAGE_ALIASES = {
    "DYSPNEA": ["shortness of breath", "dyspnea", "difficulty breathing", "breathlessness", "falta de aire", "disnea"],
    "CHEST_PAIN": ["chest pain", "thoracic pain", "chest discomfort", "dolor toracico", "dolor en el pecho"],
    "FEVER": ["fever", "pyrexia", "high temperature", "fiebre"],
    "TACHYCARDIA": ["tachycardia", "palpitations", "taquicardia"],
    "HYPERTENSION": ["hypertension", "high blood pressure", "hipertension"],
    "DIABETES": ["diabetes", "diabetes mellitus"],
    "HYPOXEMIA": ["hypoxemia", "low oxygen saturation", "spo2 baja"],
}
CONCEPT_DISPLAY = {
    "DYSPNEA": "shortness of breath", "CHEST_PAIN": "chest pain", "FEVER": "fever", "TACHYCARDIA": "tachycardia",
    "HYPERTENSION": "hypertension", "DIABETES": "diabetes", "HYPOXEMIA": "hypoxemia",
}
# Acronyms of conditions (fixed values).
ACRONYMS = {
    "uti": "urinary tract infection", "utis": "urinary tract infection", "dka": "diabetic ketoacidosis",
    "copd": "chronic obstructive pulmonary disease", "chf": "congestive heart failure", "cad": "coronary artery disease",
    "ckd": "chronic kidney disease", "htn": "hypertension", "mi": "myocardial infarction", "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism", "tb": "tuberculosis", "hiv": "human immunodeficiency virus",
    "aids": "acquired immunodeficiency syndrome", "ms": "multiple sclerosis", "ra": "rheumatoid arthritis",
    "sle": "systemic lupus erythematosus", "gerd": "gastroesophageal reflux disease", "ibs": "irritable bowel syndrome",
    "afib": "atrial fibrillation", "t2dm": "type 2 diabetes mellitus", "t1dm": "type 1 diabetes mellitus",
}
# Synonym groups for query expansion (fixed values).
SYNONYMS = {
    "dyspnea": ["shortness of breath", "difficulty breathing", "breathlessness"],
    "chest pain": ["chest discomfort", "thoracic pain", "angina"],
    "fever": ["febrile illness", "pyrexia", "elevated temperature"],
    "fatigue": ["tiredness", "weakness", "malaise"],
    "headache": ["cephalgia", "migraine"],
    "cough": ["productive cough", "dry cough"],
    "nausea": ["queasiness"],
    "vomiting": ["emesis"],
    "hypertension": ["high blood pressure", "HTN"],
    "hyperglycemia": ["high blood sugar"],
    "myocardial infarction": ["heart attack", "MI"],
    "urinary tract infection": ["UTI", "dysuria", "urinary frequency"],
    "chronic obstructive pulmonary disease": ["COPD", "chronic bronchitis", "emphysema"],
    "heart failure": ["congestive heart failure", "CHF"],
    "pulmonary embolism": ["PE", "pleuritic chest pain"],
    "diabetic ketoacidosis": ["DKA", "ketosis"],
    "abdominal pain": ["stomach pain", "epigastric pain"],
}
# Stop words (fixed values).
STOPWORDS_ES = (
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre "
    "también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto"
).split()
STOPWORDS_EN = (
    "the and to of in a is for on with as by at an be are from or that this it was were which can may not have has had but we they their our you "
    "your these those than then there here also such into over"
).split()
RELEVANCE_STOPWORDS = "and or the of in to for with patient patients may can also disease".split()
FEEDBACK_STOPWORDS = "and or the of in to for with patient patients disease symptoms".split()
NAME_STOPWORDS = "the a an of and or to in with due by for".split()
# Words that cannot be the head of a condition's name (fixed values).
NON_HEAD = (
    "acute chronic subacute recurrent persistent primary secondary tertiary essential idiopathic congenital acquired hereditary familial autoimmune viral bacterial "
    "fungal infectious benign malignant severe mild moderate disease syndrome disorder attack crisis overview introduction summary review type stage grade class"
).split()
# Section headings that hold no content of interest when chunking (fixed values).
SKIPPED_HEADINGS = [
    "products & services", "associated procedures", "mayo clinic press", "from mayo clinic to your inbox",
    "sorry something went wrong with your subscription", "thank you for subscribing!", "thank you for subscribing",
    "news from mayo clinic", "related", "find out more", "on this page",
]
# Reliability by source, and preferred sections in order (fixed values).
SOURCE_RELIABILITY = {"medlineplus.gov": 1.00, "cdc.gov": 0.95, "who.int": 0.95, "mayoclinic.org": 0.95, "nhs.uk": 0.90, "msdmanuals.com": 0.90}
PREFERRED_SECTIONS = [
    ("symptoms", 1.00), ("signs and symptoms", 1.00), ("overview", 0.95), ("causes", 0.90),
    ("diagnosis", 0.90), ("diagnosis and treatment", 0.85), ("treatment", 0.75), ("main", 0.70),
]
# URL rules (fixed values).
TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
DENIED_SUBSTRINGS = ["/login", "/signin", "/signup", "/search", "/cookie", "/privacy", "/terms"]
DENIED_SCHEMES = ["mailto", "javascript", "tel"]
