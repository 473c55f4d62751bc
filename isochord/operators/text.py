"""Caption features: keyword attributes, tf-idf, frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isochord.operators.ordered import attach
from isochord.session import inline

# Keyword lists per attribute.
LEXICONS = {
    "person": ["person", "people", "man", "men", "woman", "women", "boy", "girl", "child",
               "guy", "lady", "crowd", "he ", "she ", "they "],
    "face": ["face", "smil", "eyes", "expression", "looking", "gaze"],
    "indoor": ["room", "indoor", "inside", "kitchen", "office", "house", "bedroom", "hallway",
               "wall", "table", "interior"],
    "outdoor": ["outdoor", "outside", "street", "sky", "forest", "field", "mountain", "beach",
                "road", "car ", "tree", "building", "city"],
    "action": ["run", "walk", "fight", "jump", "move", "driv", "danc", "throw", "chase", "fall",
               "grab", "push", "fast"],
    "talk": ["talk", "speak", "say", "conversa", "telling", "asks", "shout"],
    "tension": ["tense", "anger", "angry", "fear", "scream", "cry", "danger", "dark", "blood",
                "gun", "weapon", "fight", "threat", "panic", "scared"],
}

# Words never mined as labels.
MINING_STOP_WORDS = (
    "the a an and or of to in on at is are was were be been with for this that these those it "
    "its his her their they he she you we as by from into over under then there here who which "
    "what while two one scene video features shows depicting appears seems various different "
    "first second").split()

# Labels that mining must not repeat.
OBJECT_LABELS = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog",
    "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite",
    "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich",
    "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote",
    "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book",
    "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
]
SCENE_LABELS = [
    "indoor scene", "outdoor scene", "kitchen", "bedroom", "living room", "office", "hallway",
    "street", "city", "forest", "field", "mountain", "beach", "sky", "road", "restaurant",
    "store", "stadium", "night scene", "daytime scene",
]
ACTION_LABELS = [
    "people talking", "a person running", "a person walking", "people fighting",
    "a person driving", "people dancing", "a person falling", "a crowd of people",
    "a close-up of a face", "fast motion", "a violent scene", "a calm scene",
]


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))
    return (gone / F.lit(len(word.encode()))).cast("bigint")


def caption_hits(captions: DataFrame, text: str = "text") -> DataFrame:
    """Keyword hits per attribute, one column each."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    d = captions.withColumn("__t", padded)
    hits = {name: sum((occurrences(F.col("__t"), w) for w in words[1:]),
                      occurrences(F.col("__t"), words[0])) for name, words in LEXICONS.items()}
    return d.select(*[c for c in captions.columns if c != text],
                    *[h.alias(name) for name, h in hits.items()])


def caption_attributes(captions: DataFrame, text: str = "text") -> DataFrame:
    """Keyword hits standardised per attribute over all captions."""
    # one exchange of the small counts serves both the moments and the rows
    hits = caption_hits(captions, text).repartition(*[c for c in captions.columns if c != text])
    stats = hits.agg(*[F.avg(n).alias(f"__m_{n}") for n in LEXICONS],
                     *[F.stddev_pop(n).alias(f"__s_{n}") for n in LEXICONS])
    rest = [c for c in hits.columns if c not in LEXICONS]
    return attach(hits, stats, []).select(*rest, *[
        ((F.col(n) - F.col(f"__m_{n}")) / (F.col(f"__s_{n}") + F.lit(1e-9))).alias(n)
        for n in LEXICONS])


def term_counts(docs: DataFrame, doc: str, text: str, stop_words: list[str]) -> DataFrame:
    """(doc, term, tf): words of two or more letters or digits, lower-cased.

    Texts are placed by document first: a text is smaller than its exploded words, and
    both the counts here and any later sum over a document then need no other shuffle.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))),
                                 F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return (docs.select(doc, text).repartition(doc).select(doc, F.explode(words).alias("term"))
            .filter(F.col("term").isNotNull() & ~F.col("term").isin(stop_words))
            .groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")))


def tfidf(docs: DataFrame, doc: str, text: str, stop_words: list[str],
          max_features: int = 4096) -> DataFrame:
    """Unit-length tf-idf entries over the most frequent terms.

    idf = ln((1 + n) / (1 + df)) + 1; ties at the vocabulary limit go alphabetically.
    """
    counts = term_counts(docs, doc, text, stop_words)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = (counts.groupBy("term").agg(F.sum("tf").alias("total"),
                                        F.count(F.lit(1)).alias("df"))
             .orderBy(F.col("total").desc(), "term").limit(max_features))
    idf = attach(vocab, n_docs, []).select(
        "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    # the vocabulary is at most max_features rows
    raw = counts.join(F.broadcast(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", (F.col("raw") / length).alias("weight"))


def lexicon_scores(docs: DataFrame, doc: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(doc, category, score): share of a document's words that a category lists.

    ``lexicon`` has (word, category). Words are counted per document before the join.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))),
                                            r"[^\p{L}\p{N}_]+", " ")), " ")
    counts = (docs.select(doc, text).repartition(doc).select(doc, F.explode(words).alias("word"))
              .filter("word != ''").groupBy(doc, "word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.groupBy(doc).agg(F.sum("n").alias("n_words"))
    return (counts.join(lexicon, "word").groupBy(doc, "category").agg(F.sum("n").alias("n"))
            .join(total, doc).select(doc, "category", (F.col("n") / F.col("n_words")).alias("score")))


def mined_labels(captions: DataFrame, order: str, text: str = "text",
                 n_mined: int = 30) -> DataFrame:
    """Most frequent words of four or more plain letters that are not yet labels.

    Equal counts keep the order of first appearance.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))),
                                 F.lit("[a-z]{4,}"), F.lit(0))
    known = MINING_STOP_WORDS + OBJECT_LABELS + SCENE_LABELS + ACTION_LABELS
    return (captions.select(order, text).select(order, F.posexplode(words).alias("pos", "word"))
            .filter(~F.col("word").isin(known))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"),
                                 F.min(F.struct(order, "pos")).alias("first"))
            .orderBy(F.col("n").desc(), "first").limit(n_mined).select("word", "n"))


def label_bank(captions: DataFrame, order: str, text: str = "text",
               n_mined: int = 30) -> DataFrame:
    """All labels with their kind: fixed objects, scenes, actions, then mined words."""
    fixed = ([(w, "object") for w in OBJECT_LABELS] + [(w, "scene") for w in SCENE_LABELS]
             + [(w, "action") for w in ACTION_LABELS])
    return inline(captions.sparkSession, fixed, ["label", "kind"]).unionByName(
        mined_labels(captions, order, text, n_mined)
        .select(F.col("word").alias("label"), F.lit("mined").alias("kind")))


def clip_id(path: Column) -> Column:
    """All digits of the file stem as a number."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"\D", "").cast("bigint")
