"""The named queries.

Every query takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` (through the stand-in views of ``lendframe.sources.fixtures``)
and returns a DataFrame (medians, dictionaries, fitted models and file round
trips run jobs while the query is built).  Doubles are rounded in the final projection
only, so that results hash the same as the SQL oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.functions import fixed
from lendframe.functions import text as TX
from lendframe.operators import amount as A
from lendframe.operators import batches as B
from lendframe.operators import category as C
from lendframe.operators import ensemble as E
from lendframe.operators import images as IMG
from lendframe.operators import metrics as M
from lendframe.operators import model as MD
from lendframe.operators import shift as SH
from lendframe.operators import tags as TAGS
from lendframe.operators import target as TG
from lendframe.operators import tokens as TK
from lendframe.sources import files as FILES
from lendframe.sources import fixtures as fx
from lendframe.sources.tables import write_and_read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIGITS = 4


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def reuse(df: DataFrame) -> DataFrame:
    """Keep a DataFrame that several branches of one plan read (memory, then
    local disk; a lost block is recomputed from its lineage)."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _r(col, digits: int = DIGITS):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits)


# ---------------------------------------------------------------------------
# Stated amount, rates, conversion, ensemble, override (the flagship chain)
# ---------------------------------------------------------------------------

def _recent_desc(spark, sf_dir, loans):
    """v2 amounts of all loans (target kept), the recent median rate and
    the converted amounts: one extraction pass, no join back to the loans."""
    # The amounts feed the rate and the conversion: extract them once.
    local = reuse(A.extract_local_amount(loans, version=2, keep=["LOAN_AMOUNT"]))
    rate = A.median_rate(local, min_loan_id=fx.recent_cutoff(spark, sf_dir))
    return local, rate, A.convert_usd(local, rate)


@query
def corrected_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    _, _, desc = _recent_desc(spark, sf_dir, loans)
    # Test loans are the rows without a target; their currency is in desc.
    test_desc = desc.where(F.col("LOAN_AMOUNT").isNull())
    # Prediction files hold the loans to submit, the test loans; averaging
    # only those skips the training loans' predictions before the shuffle.
    mean = E.ensemble_mean(fx.predictions(spark, sf_dir, fx.test(loans)), n_models=fx.N_MODELS)
    out = E.corrected_submission(test_desc, mean, test_desc)
    return out.select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def extract_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = A.extract_local_amount(fx.loan(spark, sf_dir), version=2)
    return local.select("LOAN_ID", "CURRENCY", _r(A.LOCAL).alias(A.LOCAL))


@query
def extract_amount_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = A.extract_local_amount(fx.loan(spark, sf_dir), version=1)
    return local.select("LOAN_ID", "CURRENCY", _r(A.LOCAL).alias(A.LOCAL))


@query
def median_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate base of the stated-amount feature: v1 amounts, all training loans."""
    loans = fx.loan(spark, sf_dir)
    rate = A.median_rate(A.extract_local_amount(loans, 1, keep=["LOAN_AMOUNT"]))
    return rate.select("CURRENCY", _r("rate", 6).alias("rate"))


@query
def median_rate_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate base of the override: v2 amounts, recent training loans only."""
    _, rate, _ = _recent_desc(spark, sf_dir, fx.loan(spark, sf_dir))
    return rate.select("CURRENCY", _r("rate", 6).alias("rate"))


@query
def median_rate_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median rates from sketches stored by ranges of loan ids (written in two goes, the second as a new
    day of loans): for each currency, its rates and whether the exact rank of the sketch's median
    lies within four times the sketch's rank error (1) or not (0)."""
    base = reuse(A.rate_base(A.extract_local_amount(fx.loan(spark, sf_dir), 1, keep=["LOAN_AMOUNT"])))
    path, cut = FILES.scratch_path(spark, "rate-sketches"), fx.recent_cutoff(spark, sf_dir)
    span = 500
    old = F.floor(F.col("LOAN_ID") / span) <= F.floor(cut / span)
    for rows in (base.where(old), base.where(~old)):
        A.write_rate_sketches(A.rate_sketches(rows, span), path)
    found = A.sketched_median_rate(spark.read.parquet(path)).withColumnRenamed("rate", "_median")
    known = base.where(F.col("rate").isNotNull()).join(found, "CURRENCY")
    ranks = known.groupBy("CURRENCY", "n").agg(F.avg((F.col("rate") < F.col("_median")).cast("double")).alias("low"),
                                               F.avg((F.col("rate") <= F.col("_median")).cast("double")).alias("high"))
    off = F.lit(4 * A.SKETCH_RANK_ERROR)
    return ranks.select("CURRENCY", "n", ((F.col("low") <= 0.5 + off) & (F.col("high") >= 0.5 - off)).cast("int").alias("within"))


@query
def convert_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, desc = _recent_desc(spark, sf_dir, fx.loan(spark, sf_dir))
    return desc.select("LOAN_ID", "CURRENCY", _r(A.DESC).alias(A.DESC))


def _amount_feature(spark, sf_dir, loans):
    local = reuse(A.extract_local_amount(loans, version=1, keep=["LOAN_AMOUNT"]))
    desc = A.convert_usd(local, A.median_rate(local))
    mean, std = TG.stat_columns(fx.train(loans))
    return A.amount_feature(desc, mean, std)


@query
def amount_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _amount_feature(spark, sf_dir, fx.loan(spark, sf_dir))
    return f.select("LOAN_ID", _r("LOAN_AMOUNT_DESC_LOG_Z", 6).alias("LOAN_AMOUNT_DESC_LOG_Z"),
                    "LOAN_AMOUNT_DESC_LOG_Z_isna")


@query
def currency_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    _, _, desc = _recent_desc(spark, sf_dir, loans)
    out = A.trusted_amount(desc.where(F.col("LOAN_AMOUNT").isNull()))
    return out.select("LOAN_ID", "CURRENCY", _r(A.DESC).alias(A.DESC))


@query
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = E.ensemble_mean(fx.predictions(spark, sf_dir), n_models=fx.N_MODELS)
    return mean.select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def ensemble_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble as the original ran it, from files: the 16 prediction
    sets are written as CSV (one folder per model) and read back in one
    scan; the number of sets is counted from what was read."""
    path = FILES.scratch_path(spark, "predictions")
    FILES.write_prediction_sets(fx.predictions(spark, sf_dir), path)
    mean = E.ensemble_mean(FILES.read_prediction_sets(spark, path))
    return mean.select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def ensemble_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble over the loans of a sample submission file, from one prediction file a
    model, read in one scan; the model is known by the file's name."""
    loans = fx.loan(spark, sf_dir)
    folder, sample = FILES.scratch_path(spark, "named-predictions"), FILES.scratch_path(spark, "sample-submission")
    paths = fx.write_prediction_files(fx.predictions(spark, sf_dir, loans), folder)
    FILES.write_csv(fx.test(loans).select("LOAN_ID", F.lit(0.0).alias("LOAN_AMOUNT")), sample)
    scaffold = FILES.read_feature_csv(spark, sample, "LOAN_ID long, LOAN_AMOUNT double").select("LOAN_ID")
    mean = E.ensemble_mean(FILES.read_predictions(spark, paths), n_models=len(paths))
    return scaffold.join(mean, "LOAN_ID", "left").select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


# ---------------------------------------------------------------------------
# Per-epoch outputs and metrics
# ---------------------------------------------------------------------------

def _epoch_predictions(spark, sf_dir):
    """The sixteen prediction sets as epochs 0 to 15 of one model."""
    return fx.predictions(spark, sf_dir).withColumnRenamed("model_id", "epoch")


@query
def epoch_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs 8 to 10 written, epoch 9 written again with other amounts, all read back."""
    preds, path = _epoch_predictions(spark, sf_dir), FILES.scratch_path(spark, "epochs")
    FILES.write_epoch_outputs(preds, path)
    FILES.write_epoch_outputs(preds.where("epoch = 9").withColumn("LOAN_AMOUNT", F.col("LOAN_AMOUNT") * 2), path)
    return FILES.read_epoch_outputs(spark, path).select("epoch", "LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of each kept epoch, observed in the pass that writes its predictions."""
    truth = fx.train(fx.loan(spark, sf_dir)).select("LOAN_ID", F.col("LOAN_AMOUNT").alias("y"))
    preds = _epoch_predictions(spark, sf_dir).where(F.col("epoch").isin(*fixed.KEPT_EPOCHS)).join(truth, "LOAN_ID", "left")
    path = FILES.scratch_path(spark, "observed-epochs")
    seen = M.observe_epochs(preds, "y", "LOAN_AMOUNT", fixed.KEPT_EPOCHS, lambda rows: FILES.write_epoch_outputs(rows.drop("y"), path))
    return seen.select("epoch", "n", _r("mae").alias("mae"), _r("std").alias("std"))


@query
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running errors of two runs appended to a log; the first run is appended
    twice, as a retried job would."""
    path = FILES.scratch_path(spark, "metrics-log")
    rows = running_mae(spark, sf_dir)
    for run in ("first", "first", "second"):
        FILES.append_metrics(rows.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------
# Sentences
# ---------------------------------------------------------------------------

@query
def sentences_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sentence_rows(fx.loan(spark, sf_dir), version=1)


@query
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sentence_rows(fx.loan(spark, sf_dir), version=2)


@query
def sentences_with_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sentences_with_currency(fx.loan(spark, sf_dir))


# ---------------------------------------------------------------------------
# Sources, projections and text
# ---------------------------------------------------------------------------

@query
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table as a CSV reader would deliver it: null tokens applied
    to every text column, the columns of the train/test schema."""
    loans = fx.loan(spark, sf_dir).select(*FILES.LOAN_COLUMNS)
    out = FILES.apply_null_tokens(loans, FILES.LOAN_TEXT_COLUMNS)
    return out.withColumn("CURRENCY_EXCHANGE_COVERAGE_RATE", _r("CURRENCY_EXCHANGE_COVERAGE_RATE"))


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan reader end to end: the loan rows are written as one CSV
    dataset (header, quoted multi-line-safe fields) and read back through the
    text schema, null tokens and typing.  Same result as ``scan_project``."""
    path = FILES.scratch_path(spark, "loans-csv")
    FILES.write_loans_csv(fx.loan(spark, sf_dir).select(*FILES.LOAN_COLUMNS), path)
    back = FILES.read_loans_csv(spark, path)
    return back.withColumn("CURRENCY_EXCHANGE_COVERAGE_RATE", _r("CURRENCY_EXCHANGE_COVERAGE_RATE"))


@query
def scan_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan CSV with broken records: every record is a loan (reason ``ok``) or is
    rejected with its reason; ``record`` is its first field as it stands in the file."""
    path = FILES.scratch_path(spark, "broken-csv")
    fx.loan_csv_lines(fx.loan(spark, sf_dir), FILES.LOAN_COLUMNS).write.text(path)
    loans, rejects = FILES.read_loans_csv_checked(spark, path, header=False)
    good = loans.select(F.col("LOAN_ID").cast("string").alias("record"), F.lit("ok").alias("reason"), "LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))
    bad = rejects.select(F.regexp_extract("record", "^([^,]*)", 1).alias("record"), F.array_join("reasons", ",").alias("reason"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def coalesce_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.loan(spark, sf_dir).select("LOAN_ID", TX.fill_description().alias("DESCRIPTION_TRANSLATED"))


def _normalized(spark, sf_dir, lower):
    return fx.loan(spark, sf_dir).select(
        "LOAN_ID",
        TX.normalize_text(TX.fill_description(), lower).alias("DESCRIPTION_TRANSLATED"),
        TX.normalize_text("LOAN_USE", lower).alias("LOAN_USE"))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir, True)


@query
def normalize_text_keep_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir, False)


@query
def token_window(spark: SparkSession, sf_dir: str, max_len: int = 256) -> DataFrame:
    """Per loan and text field: tokens kept, padding and the last kept
    token of the fixed-length window."""
    norm = _normalized(spark, sf_dir, True)
    long = norm.select("LOAN_ID", F.explode(F.array(
        F.struct(F.lit("DESCRIPTION_TRANSLATED").alias("field"), F.col("DESCRIPTION_TRANSLATED").alias("text")),
        F.struct(F.lit("LOAN_USE").alias("field"), F.col("LOAN_USE").alias("text")))).alias("t"))
    toks = TX.words(F.col("t.text"))
    window = TX.token_window(toks, max_len)
    mask = TX.attention_mask(toks, max_len)
    n = F.aggregate(mask, F.lit(0), lambda acc, m: acc + m)
    return long.select(
        "LOAN_ID", F.col("t.field").alias("field"),
        n.cast("bigint").alias("n_tokens"),
        (F.lit(max_len) - n).cast("bigint").alias("n_pad"),
        F.when(n > 0, F.element_at(window, F.greatest(n, F.lit(1)))).alias("last_token"))


def _token_fields(loans: DataFrame) -> DataFrame:
    """(LOAN_ID, LOAN_AMOUNT, field, tokens): the words of each normalised text field."""
    fields = zip(MD.TEXT_FIELDS, MD.text_columns(loans))
    return loans.select("LOAN_ID", "LOAN_AMOUNT", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), words.alias("tokens")) for name, words in fields])).alias("t")).select(
            "LOAN_ID", "LOAN_AMOUNT", "t.field", "t.tokens")


@query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids fitted over both text fields of all training loans."""
    fields = _token_fields(fx.loan(spark, sf_dir))
    return TK.fit_vocabulary(fields.where(F.col("LOAN_AMOUNT").isNotNull()), ["tokens"])


@query
def token_ids(spark: SparkSession, sf_dir: str, max_len: int = 256) -> DataFrame:
    """Padded token ids and mask of every loan and text field (as text), by the
    vocabulary of the training loans."""
    fields = _token_fields(fx.loan(spark, sf_dir))
    words = TK.fit_vocabulary(fields.where(F.col("LOAN_AMOUNT").isNotNull()), ["tokens"])
    ids = TK.token_ids(fields, ["LOAN_ID", "field"], "tokens", words, max_len)
    return ids.select("LOAN_ID", "field", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
                      F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"))


# ---------------------------------------------------------------------------
# Mini-batches
# ---------------------------------------------------------------------------

TRAIN_BATCH = 128
EPOCHS = [1, 2, 3]


@query
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches of three epochs, another order in each."""
    rows = fx.train(fx.loan(spark, sf_dir)).select("LOAN_ID")
    return B.epoch_batches(rows, "LOAN_ID", EPOCHS, TRAIN_BATCH)


@query
def prediction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered batches of the loans to predict."""
    return B.ordered_batches(fx.test(fx.loan(spark, sf_dir)).select("LOAN_ID"), "LOAN_ID", TRAIN_BATCH)


# ---------------------------------------------------------------------------
# Categories
# ---------------------------------------------------------------------------

@query
def composite_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    return loans.select("LOAN_ID", *[C.composite(parts).alias(C.column_name(name))
                                     for name, parts in fixed.COMPOSITES.items()])


def _dictionary(spark, sf_dir, loans=None, variables=None):
    loans = loans if loans is not None else fx.loan(spark, sf_dir)
    return loans, C.fit_dictionary(fx.train(loans), variables)


@query
def category_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)[1]


@query
def dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dictionary_size(_dictionary(spark, sf_dir)[1])


@query
def category_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans, d = _dictionary(spark, sf_dir)
    return C.encode_long(loans, d)


@query
def category_encode_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine-variable family (policy and rate merged), one id column per
    variable."""
    loans, d = _dictionary(spark, sf_dir, variables=fixed.CATEGORY_VARIABLES_9)
    return C.encode_wide(loans, d, fixed.CATEGORY_VARIABLES_9)


# ---------------------------------------------------------------------------
# Tags
# ---------------------------------------------------------------------------

@query
def tags_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAGS.onehot(fx.loan(spark, sf_dir))


@query
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TAGS.tag_frequency(fx.loan(spark, sf_dir))


# ---------------------------------------------------------------------------
# Target
# ---------------------------------------------------------------------------

@query
def target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = TG.target_stats(fx.train(fx.loan(spark, sf_dir)))
    return s.select(_r("y_log_mean", 9).alias("y_log_mean"), _r("y_log_std", 9).alias("y_log_std"), "n_train")


@query
def target_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = TG.with_target_zscore(fx.train(fx.loan(spark, sf_dir)))
    return z.select("LOAN_ID", _r("y_log_z", 6).alias("y_log_z"))


@query
def denormalize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fx.train(fx.loan(spark, sf_dir))
    mean, std = TG.stat_columns(train)
    back = TG.denormalize(TG.zscore(F.col("LOAN_AMOUNT"), mean, std), mean, std)
    return train.select("LOAN_ID", _r(back).alias("LOAN_AMOUNT"),
                        (F.abs(back - F.col("LOAN_AMOUNT")) <= F.col("LOAN_AMOUNT") * 1e-9)
                        .cast("int").alias("exact"))


@query
def union_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    cols = ["LOAN_ID", "CURRENCY", "LOAN_AMOUNT"]
    train = fx.train(loans).select(*cols)
    test = fx.test(loans).select("LOAN_ID", "CURRENCY")
    both = train.unionByName(test, allowMissingColumns=True)
    return both.select("LOAN_ID", "CURRENCY", "LOAN_AMOUNT",
                       F.col("LOAN_AMOUNT").isNotNull().cast("int").alias("is_train"))


# ---------------------------------------------------------------------------
# Metrics and split
# ---------------------------------------------------------------------------

@query
def mae_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    m = M.mae_by_model(fx.predictions(spark, sf_dir, loans), fx.train(loans))
    return m.select("model_id", _r("mae").alias("mae"))


@query
def running_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.metrics_log_base(spark, sf_dir)
    r = M.running_mean_std(log, group="epoch", order="event_id", value="mae", scale=100, number_steps=True)
    return r.select("epoch", "step", _r("mae_mean", 6).alias("mae_mean"), _r("mae_std", 6).alias("mae_std"))


@query
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.holdout_split(fx.train(fx.loan(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Images and additional features
# ---------------------------------------------------------------------------

@query
def image_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    return IMG.image_presence(loans, fx.images(spark, sf_dir, loans))


@query
def detection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    loans = fx.loan(spark, sf_dir)
    return IMG.detection_count(loans, fx.images(spark, sf_dir, loans), fx.detections(spark, sf_dir))


@query
def join_additional_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans left-joined with the face counts and the stated-amount feature."""
    # read by four branches, each for its own columns
    loans = write_and_read(fx.loan(spark, sf_dir).drop(*fx.HELPER_COLUMNS), "loans")
    faces = IMG.detection_count(loans, fx.images(spark, sf_dir, loans), fx.detections(spark, sf_dir))
    feat = _amount_feature(spark, sf_dir, loans)
    out = loans.select("LOAN_ID").join(faces, "LOAN_ID", "left").join(feat, "LOAN_ID", "left")
    return out.select("LOAN_ID", "NUM_FACES",
                      _r("LOAN_AMOUNT_DESC_LOG_Z", 6).alias("LOAN_AMOUNT_DESC_LOG_Z"),
                      "LOAN_AMOUNT_DESC_LOG_Z_isna")


@query
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image lookup through the file system: the images are written as files, their folder
    is listed (paths only, no content is read), and a loan whose file is missing gets 0."""
    loans = fx.loan(spark, sf_dir)
    folder = FILES.scratch_path(spark, "images")
    fx.write_image_files(fx.images(spark, sf_dir, loans), folder)
    return IMG.image_presence(loans, IMG.image_ids_from_files(FILES.list_image_files(spark, folder)))


@query
def feature_csv_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The face counts written as a feature CSV, read back and left-joined to the loans."""
    loans = fx.loan(spark, sf_dir)
    path = FILES.scratch_path(spark, "num-faces")
    FILES.write_csv(IMG.detection_count(loans, fx.images(spark, sf_dir, loans), fx.detections(spark, sf_dir)), path)
    faces = FILES.read_feature_csv(spark, path, "LOAN_ID long, NUM_FACES int")
    return loans.select("LOAN_ID").join(faces, "LOAN_ID", "left")


# ---------------------------------------------------------------------------
# Covariate shift (bounded batches)
# ---------------------------------------------------------------------------

SHIFT_BATCH = 128
SHIFT_BUCKET_ROWS = 256


def _batched(spark, sf_dir):
    return SH.assign_batches(fx.shift(spark, sf_dir), SHIFT_BATCH, SHIFT_BUCKET_ROWS)


def _null_nan(c: str):
    return F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c))


@query
def kernel_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = SH.kernel_width(_batched(spark, sf_dir))
    return w.select("bucket", "batch", _r(_null_nan("kernel_width"), 6).alias("kernel_width"))


@query
def kernel_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = SH.batch_weights(_batched(spark, sf_dir))
    return w.select("vec_id", _r(_null_nan("kappa"), 6).alias("kappa"))


@query
def density_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = SH.batch_weights(_batched(spark, sf_dir))
    return w.select("vec_id", _r("weight", 6).alias("weight"))


@query
def density_ratio_kmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel-mean-matching weights, the quadratic program solved per batch
    (rows-only check; the tests check optimality conditions instead)."""
    w = SH.batch_weights(_batched(spark, sf_dir), method="kmm")
    return w.select("vec_id", _r("weight", 6).alias("weight"))


@query
def weighted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-row predictions of a regression trained with the matching
    weights on the training rows (rows-only check: Spark ML values)."""
    batched = _batched(spark, sf_dir)
    weights = SH.batch_weights(batched, method="kmm")
    model = SH.fit_weighted_regression(batched, weights)
    return SH.predict_shifted(model, batched).select("vec_id", _r("prediction", 6).alias("prediction"))


@query
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = _batched(spark, sf_dir)
    loss = SH.weighted_loss(SH.batch_weights(batched), batched)
    return loss.select("bucket", "batch", _r("weighted_loss", 6).alias("weighted_loss"))


# ---------------------------------------------------------------------------
# Spark ML
# ---------------------------------------------------------------------------

NUMERIC_FEATURES = ["LOAN_AMOUNT_DESC_LOG_Z", "LOAN_AMOUNT_DESC_LOG_Z_isna", "NUM_FACES"]


def _features(spark, sf_dir, variables=None, plain=False):
    # Read by the dictionary fit, the encoding, the tags, the text, the
    # stated amounts and the face counts, each for its own columns: build
    # the loan rows once as a parquet table, which every reader prunes.
    loans = write_and_read(fx.loan(spark, sf_dir).drop(*fx.HELPER_COLUMNS), "loans")
    train = fx.train(loans)
    dictionary = C.fit_dictionary(train, variables)
    faces = IMG.detection_count(loans, fx.images(spark, sf_dir, loans), fx.detections(spark, sf_dir))
    extra = _amount_feature(spark, sf_dir, loans).join(faces, "LOAN_ID", "left")
    return loans, train, dictionary, MD.feature_table(loans, dictionary, variables, extra=extra, plain=plain)


@query
def feature_vector_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the feature vectors that the pipeline assembles over all loan
    rows, and of the blocks they are assembled from: one-hot ids, hashed text,
    tag flags and numeric features."""
    from pyspark.ml import Pipeline
    _, _, _, features = _features(spark, sf_dir)
    features = write_and_read(features, "features")
    stages = MD.feature_pipeline(MD.id_columns(), NUMERIC_FEATURES)
    vectors = Pipeline(stages=stages).fit(features).transform(features)
    size = lambda cols: sum((MD.vector_size(c) for c in cols), F.lit(0)).cast("bigint")
    inputs = stages[-1].getInputCols()
    onehot, texts = [c for c in inputs if c.endswith("_oh")], [c for c in inputs if c.startswith("idf_")]
    flags = [c for c in inputs if c not in onehot + texts + NUMERIC_FEATURES]
    count = lambda cols: sum((F.col(c).isNotNull().cast("bigint") for c in cols), F.lit(0)).cast("bigint")
    # one row, or one for each width there is
    return vectors.select(
        size(onehot).alias("category_block"), size(texts).alias("text_block"), count(flags).alias("tag_block"),
        count([c for c in inputs if c in NUMERIC_FEATURES]).alias("numeric_block"), size(["features"]).alias("width")).distinct()


@query
def text_hash_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed term counts of every normalised text field (rows-only check:
    the hash function is Spark's own): words and buckets of each field, and
    of all fields together."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    loans = fx.loan(spark, sf_dir)
    hashed = loans.select("LOAN_ID", *MD.text_columns(loans))
    out, n_words, n_buckets = [], F.lit(0), F.lit(0)
    for f in MD.TEXT_FIELDS:
        hashed = HashingTF(inputCol=f"words_{f}", outputCol=f"tf_{f}", numFeatures=MD.TEXT_DIM).transform(hashed)
        words, buckets = F.size(f"words_{f}"), F.size(F.filter(vector_to_array(F.col(f"tf_{f}")), lambda x: x != 0))
        out += [words.alias(f"n_words_{f}"), buckets.alias(f"n_buckets_{f}")]
        n_words, n_buckets = n_words + words, n_buckets + buckets
    return hashed.select("LOAN_ID", n_words.alias("n_words"), n_buckets.alias("n_buckets"), *out)


def _character_encoder():
    """A text encoder without a model: characters, words, digits and distinct characters."""
    return lambda texts: [[len(t), len(t.split()), sum(c in "0123456789" for c in t), len(set(t))] for t in texts]


@query
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoder hook over the normalised descriptions: a vector of fixed size from an encoder that each worker loads once."""
    text = _normalized(spark, sf_dir, True).select("LOAN_ID", F.coalesce("DESCRIPTION_TRANSLATED", F.lit("")).alias("text"))
    encoded = MD.encode_text(text, "text", "vector", 4, _character_encoder, "characters")
    names = ["n_chars", "n_words", "n_digits", "n_distinct"]
    return encoded.select("LOAN_ID", *[F.get("vector", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)])


@query
def holdout_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout error in USD (rows-only check): the pipeline is fitted on the
    hashed 80 % of the training loans and scored on the other 20 %, next to
    the constant predictor exp(mean ln y)."""
    loans, train, _, features = _features(spark, sf_dir)
    labelled = write_and_read(features.where(F.col("LOAN_AMOUNT").isNotNull())
                              .withColumn("is_holdout", M.holdout_flag(F.col("LOAN_ID"))), "labelled")
    out = MD.evaluate_variants(labelled.where("is_holdout = 0"), labelled.where("is_holdout = 1"), train,
                               MD.id_columns(), NUMERIC_FEATURES)
    return out.select("variant", _r("mae").alias("mae"))


@query
def regress_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the pipeline on the training loans, predict the test loans in USD."""
    loans, train, _, features = _features(spark, sf_dir)
    # The fit makes several passes, each over columns of its own: written once.
    features = write_and_read(features, "features")
    model = MD.fit_regressor(features.where(F.col("LOAN_AMOUNT").isNotNull()), MD.id_columns(),
                             NUMERIC_FEATURES)
    pred = MD.predict_amount(model, features.where(F.col("LOAN_AMOUNT").isNull()), train)
    return pred.select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def predict_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``regress_predict``, but the pipeline is saved with the target's statistics, loaded
    again and applied without the training table (rows-only check: Spark ML values)."""
    _, train, _, features = _features(spark, sf_dir)
    features = write_and_read(features, "features")
    model = MD.fit_regressor(features.where(F.col("LOAN_AMOUNT").isNotNull()), MD.id_columns(), NUMERIC_FEATURES)
    path = FILES.scratch_path(spark, "model")
    FILES.save_model(MD.with_denormalizer(model, train), path)
    pred = MD.predict_with(FILES.load_pipeline_model(path), features.where(F.col("LOAN_AMOUNT").isNull()))
    return pred.select("LOAN_ID", _r("LOAN_AMOUNT").alias("LOAN_AMOUNT"))


@query
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout error in USD of the model variants: ten or nine categories, normalised or plain text,
    with and without the stated amount and the face count, linear and boosted trees (rows-only check)."""
    from pyspark.ml import Pipeline
    variables = fixed.CATEGORY_VARIABLES_10 + [v for v in fixed.CATEGORY_VARIABLES_9 if v not in fixed.CATEGORY_VARIABLES_10]
    _, train, _, features = _features(spark, sf_dir, variables, plain=True)
    labelled = features.where(F.col("LOAN_AMOUNT").isNotNull()).withColumn("is_holdout", M.holdout_flag(F.col("LOAN_ID")))
    labelled = write_and_read(labelled, "grid-rows")
    shared = Pipeline(stages=MD.grid_stages(MD.id_columns(variables))).fit(labelled.where("is_holdout = 0")).transform(labelled)
    out = MD.evaluate_grid(shared.where("is_holdout = 0"), shared.where("is_holdout = 1"), train)
    return out.select("variant", _r("mae").alias("mae"))
