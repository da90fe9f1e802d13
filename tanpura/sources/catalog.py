"""The catalogues: ragas, talas, styles, file-name rules, messages and defaults, each a small table in declared order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
RAGAS = [
    ("bhairavi", "Bhairavi", "Morning", "Serene, Devotional", "One of the most fundamental ragas in Hindustani classical music, evoking a sense of devotion and serenity.", ["Sa", "Komal Re", "Komal Ga", "Ma", "Pa", "Komal Dha", "Komal Ni", "Sa"]),
    ("yaman", "Yaman", "Evening", "Peaceful, Romantic", "A popular evening raga known for its pleasing and romantic mood.", ["Sa", "Re", "Ga", "Ma Tivra", "Pa", "Dha", "Ni", "Sa"]),
    ("desh", "Desh", "Evening", "Light, Joyful", "A light and popular raga that expresses joy and is often used in semi-classical compositions.", ["Sa", "Re", "Ma", "Pa", "Ni Komal", "Sa"]),
    ("malkauns", "Malkauns", "Night", "Deep, Meditative", "A serious midnight raga that creates a meditative and profound atmosphere.", ["Sa", "Ga Komal", "Ma", "Dha Komal", "Ni Komal", "Sa"]),
    ("bageshri", "Bageshri", "Night", "Longing, Romantic", "A beautiful night raga that evokes feelings of longing and romantic sentiment.", ["Sa", "Re Komal", "Ga", "Ma", "Pa", "Dha", "Ni Komal", "Sa"]),
    ("durga", "Durga", "Evening", "Strength, Confidence", "A pentatonic raga that evokes strength, valor, and confidence.", ["Sa", "Re", "Ma", "Pa", "Dha", "Sa"]),
    ("todi", "Todi", "Morning", "Serious, Profound", "A morning raga known for its serious and profound nature.", ["Sa", "Re Komal", "Ga Komal", "Ma Tivra", "Pa", "Dha Komal", "Ni Komal", "Sa"]),
    ("kafi", "Kafi", "Any time", "Versatile, Expressive", "A versatile raga that can express various moods and is adaptable to different styles.", ["Sa", "Re", "Ga Komal", "Ma", "Pa", "Dha", "Ni Komal", "Sa"]),
]
TALAS = [
    ("teental", "Teental", 16, "Most common tala in Hindustani classical music with 16 beats divided as 4+4+4+4", "Dha Dhin Dhin Dha | Dha Dhin Dhin Dha | Na Tin Tin Ta | Ta Dhin Dhin Dha"),
    ("jhaptaal", "Jhaptaal", 10, "10 beat cycle divided as 2+3+2+3", "Dhi Na | Dhi Dhi Na | Ti Na | Dhi Dhi Na"),
    ("ektaal", "Ektaal", 12, "12 beat cycle divided as 2+2+2+2+2+2", "Dhin Dhin | Dha Dha | Tin Tin | Ta Ta | Dhin Dhin | Dha Dha"),
    ("rupak", "Rupak", 7, "7 beat cycle divided as 3+2+2", "Ti Ti Na | Dhi Na | Dhi Na"),
    ("dadra", "Dadra", 6, "6 beat cycle divided as 3+3, commonly used in light classical music", "Dha Dhin Na | Dha Tin Na"),
    ("keherwa", "Keherwa", 8, "8 beat cycle divided as 4+4, popular in folk and light classical music", "Dha Ge Na Ti | Na Ka Dhi Na"),
]
STYLES = [
    ("dhrupad", "Dhrupad", "The oldest and most austere form of Hindustani classical music, focusing on precise rhythm and pure notes."),
    ("khayal", "Khayal", "A more ornate and imaginative style that allows for greater improvisation and creativity."),
    ("thumri", "Thumri", "A semi-classical style that emphasizes romantic and devotional themes with more flexibility in expression."),
    ("ghazal", "Ghazal", "A poetic form set to music with romantic themes, blending classical and light elements."),
    ("tarana", "Tarana", "A rhythmic style using syllables inspired by Persian and Arabic phrases, focusing on rhythm and speed."),
    ("instrumental", "Instrumental", "Pure instrumental expression using traditional instruments like sitar, sarod, or bansuri."),
]
FILE_RULES = [
    ("bhairavi", "bhairavi", "teental", 70, 0.85, ["Sa", "Komal Re", "Komal Ga", "Ma", "Pa", "Komal Dha", "Komal Ni"]),
    ("yaman", "yaman", "ektaal", 80, 0.92, ["Sa", "Re", "Ga", "Ma Tivra", "Pa", "Dha", "Ni"]),
]
NATURAL_NOTES = ["Sa", "Re", "Ga", "Ma", "Pa", "Dha", "Ni"]
MESSAGES = [
    ("analysis_ok", "Analysis Complete", "Detected Raga: {name} ({pct}% confidence)", "default"),
    ("analysis_failed", "Analysis Failed", "Could not analyze the audio file. Please try again.", "destructive"),
    ("generation_ok", "Composition Generated", "Successfully created a {duration} second composition in {name} raga.", "default"),
    ("generation_failed", "Generation Failed", "Could not generate the composition. Please try again.", "destructive"),
    ("no_file", "No File Selected", "Please select an audio file to analyze.", "destructive"),
]
UNDETECTED_MESSAGE = "Could not determine the raga with confidence"
UNDETECTED_CARD = "Could not detect raga with sufficient confidence."
DEFAULT_TEMPO, DEFAULT_DURATION, DEFAULT_CREATIVITY = 80, 60, 50
AUDIO_BASE = "https://storage.googleapis.com/demo-audio/"

RAGA_SCHEMA = "ordinal int, id string, name string, time string, mood string, description string, notes array<string>, scale struct<aroha: array<string>, avaroha: array<string>>"
TALA_SCHEMA = "ordinal int, id string, name string, beats int, description string, pattern string"
STYLE_SCHEMA = "ordinal int, id string, name string, description string"
RULE_SCHEMA = "priority int, pattern string, raga_id string, tala_id string, tempo int, confidence double, notes array<string>"
MESSAGE_SCHEMA = "kind string, title string, text_template string, severity string"


def dim_raga(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(RAGAS)], RAGA_SCHEMA)


def dim_tala(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TALAS)], TALA_SCHEMA)


def dim_style(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STYLES)], STYLE_SCHEMA)


def dim_file_rule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(FILE_RULES)], RULE_SCHEMA)


def dim_message(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MESSAGES, MESSAGE_SCHEMA)


def dim_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DEFAULT_TEMPO, DEFAULT_DURATION, DEFAULT_CREATIVITY)], "tempo int, duration int, creativity int")
