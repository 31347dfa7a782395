"""Schemas of metadata and messages, value domains and default parameters."""

from pyspark.sql import types as T

MODEL_METADATA = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("last_id", T.LongType()),
    T.StructField("path", T.StringType(), False),
    T.StructField("trained_at", T.TimestampType(), False),
])

# Similarity message on the output topic; ids are long because the listing key is a BIGINT.
SIMILAR_MESSAGE = T.StructType([
    T.StructField("announceId", T.LongType()),
    T.StructField("similarIds", T.ArrayType(T.LongType())),
    T.StructField("clusterId", T.StringType()),
])

# The older message, with the mean similarity of the neighbours.
COSINE_MESSAGE = T.StructType([
    T.StructField("announceId", T.LongType()),
    T.StructField("similarIds", T.ArrayType(T.LongType())),
    T.StructField("similarity", T.DoubleType()),
])

# They must equal the ones the marketplace uses.
INPUT_TOPIC = "new_announce_topic"
OUTPUT_TOPIC = "similar_calc_announces_topic"
TYPE_ANNONCE = ["VENTE", "LOCATION"]
STATUS_ANNONCE = ["ACTIVE", "INACTIVE", "EN_ATTENTE"]
TYPE_BIEN = ["ANY", "APARTMENT", "HOUSE", "VILLA", "STUDIO", "CONDO", "TOWNHOUSE", "PENTHOUSE", "DUPLEX", "LOFT", "BUNGALOW", "FARMHOUSE", "COTTAGE"]
ROOMS = ["ANY", "S1", "S2", "S3", "S4", "S5"]
LEASE_DURATIONS = ["ANY", "DAY", "WEEK", "MONTH", "SEMESTER", "QUARTER", "YEAR", "FLEXIBLE"]
OLD_TYPES = ["House", "Villa", "Apartment", "Studio"]
OLD_ROOMS = ["S0", "S1", "S2", "S3", "S4", "S5", "Any"]
ROLES = ["ROLE_USER", "ROLE_ADMIN"]
INTERACTION_TYPES = ["VIEW", "SAVE", "CONTACT", "RATING"]
INTERACTION_WEIGHTS = {"VIEW": 1.0, "FAVORITE": 3.0, "MESSAGE": 5.0}
# The declared types by the same scale: saving is marking as a favourite, contacting is sending a message. A rating says its
# score itself.
DECLARED_WEIGHTS = {"VIEW": 1.0, "SAVE": 3.0, "CONTACT": 5.0}
RATED_TYPE = "RATING"
FEATURE_COLUMNS = ["prix", "type_bien", "lease_duration", "latitude", "longitude"]
FEATURE_COLUMNS_OLD = ["prix", "type_bien", "latitude", "longitude"]
KMEANS_CLUSTERS = 10
KMEANS_SEED = 42
NEIGHBOURS = 10
USERS_PER_LISTING = 1000
LISTINGS_PER_USER = 100
RETRAIN_AFTER = 100
ALS_RANK = 15
ALS_ITERATIONS = 15
ALS_REG = 0.1
