"""Fixed schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

# One row per profile. `ord` is the file or key order of the record; a missing
# value is NULL. `bases` holds A, C, G, T and N only (U is stored as T).
PROFILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("bases", T.StringType()),
    T.StructField("reactivity", T.ArrayType(T.DoubleType())),
    T.StructField("molecule", T.StringType()),
])

# One row per piece of a database profile. A tile owns the positions
# [start, start + core) and carries `halo` more so that windows starting in the
# core are complete.
TILE = T.StructType([
    T.StructField("target_id", T.StringType()),
    T.StructField("target_ord", T.LongType()),
    T.StructField("target_len", T.LongType()),
    T.StructField("tile", T.LongType()),
    T.StructField("core", T.IntegerType()),
    T.StructField("bases", T.StringType()),
    T.StructField("reactivity", T.ArrayType(T.DoubleType())),
])

KMER_MATCH = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("target_ord", T.LongType()),
    T.StructField("q_pos", T.LongType()),
    T.StructField("d_pos", T.LongType()),
])

# A run of window hits on one diagonal; runs of the same diagonal merge.
ISLAND = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("target_ord", T.LongType()),
    T.StructField("diag", T.LongType()),
    T.StructField("q_first", T.LongType()),
    T.StructField("q_last", T.LongType()),
    T.StructField("n_kmers", T.LongType()),
])

MISSING_SENTINEL = -999.0
MOLECULE_DNA, MOLECULE_RNA, MOLECULE_UNKNOWN = "DNA", "RNA", "UNKNOWN"
