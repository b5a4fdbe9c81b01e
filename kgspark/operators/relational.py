"""Jobs, quizzes, limits, sessions and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.streaming.ingest import limited_table

# The roles of a share link.
ROLES = ("viewer", "editor")
#: Hits and seconds of the limits in use.
LIMITS = {"signup": (5, 3600), "login": (10, 900), "chat": (200, 86_400), "quiz": (200, 86_400)}
QUIZ_CHARS, OPTIONS = 24_000, 4


def latest(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key; equal times go to the larger tie."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, tie)).alias("r")).select(key, "r.*")


def progress(job_progress: Column, status: Column) -> Column:
    return F.coalesce(job_progress, F.when(status == "ready", 100).otherwise(0))


def valid_questions(questions: Column, n: int) -> Column:
    """The first n questions that have a text, four options with text and an answer among them."""
    ok = F.filter(
        questions,
        lambda q: (F.trim(q["question"]) != "") & (F.size(q["options"]) == OPTIONS) & F.forall(q["options"], lambda o: F.trim(o) != "") & q["answer"].between(0, OPTIONS - 1),
    )
    return F.slice(ok, F.lit(1), F.lit(n))


def valid_answers(answers: Column, keys: Column) -> Column:
    return F.coalesce((F.size(answers) == F.size(keys)) & F.forall(answers, lambda a: a.between(-1, OPTIONS - 1)), F.lit(False))


def score(answers: Column, keys: Column) -> Column:
    """Answers equal to their key; -1 stands for a skipped one."""
    return F.aggregate(F.zip_with(answers, keys, lambda a, k: F.when(a == k, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def review(answers: Column, keys: Column) -> Column:
    return F.zip_with(answers, keys, lambda a, k: F.when(a == -1, "skipped").when(a == k, "right").otherwise("wrong"))


def even_sample(chunks: DataFrame, budget: int = QUIZ_CHARS) -> DataFrame:
    """Chunks of each document, spread evenly so that their text keeps to the budget. chunks: document_id, ord, text.

    Every (n/keep)-th chunk is kept, keep being the number that fits at the mean length."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"))
    keep = F.when(F.col("total") > budget, F.greatest(F.lit(1), F.floor(F.col("n") * budget / F.col("total")))).otherwise(F.col("n")).cast("long")
    # numbers within blocks of ords, then what the blocks before hold: no task gets a whole document
    cut = chunks.withColumn("_b", F.floor(F.col("ord") / 1024))
    sizes = cut.groupBy("document_id", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("document_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("document_id", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("document_id", "_b").orderBy("ord", "chunk_id")) - 1
    placed = cut.withColumn("_at", at).join(base, ["document_id", "_b"]).withColumn("i", F.col("_at") + F.col("_base")).drop("_at", "_base", "_b")
    j = placed.join(n.withColumn("keep", keep), "document_id")
    # i is picked if it is floor(m * n / keep) for a whole m
    m = F.ceil(F.col("i") * F.col("keep") / F.col("n"))
    return j.where((F.floor(m * F.col("n") / F.col("keep")) == F.col("i")) & (m < F.col("keep"))).drop("n", "total", "keep", "i")


def responses(quizzes: DataFrame, attempts: DataFrame) -> DataFrame:
    """(quiz_id, responses) of every quiz."""
    return quizzes.join(attempts.groupBy("quiz_id").agg(F.count("*").alias("responses")), "quiz_id", "left").select("quiz_id", F.coalesce("responses", F.lit(0)).cast("bigint").alias("responses"))


def attempts_of(attempts: DataFrame, quizzes: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts with their quiz's title and their user's email, for the pages of a quiz and of a user."""
    return attempts.join(quizzes.select("quiz_id", "title"), "quiz_id").join(users.select("user_id", "email"), "user_id")


def token_hash(token: Column) -> Column:
    """What is stored of a session's token."""
    return F.sha2(token, 256)


def new_attempts(attempts: DataFrame, existing: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Attempts of users who have none at that quiz and do not own it."""
    fresh = attempts.dropDuplicates(["quiz_id", "user_id"]).join(existing.select("quiz_id", "user_id"), ["quiz_id", "user_id"], "left_anti")
    return fresh.join(quizzes.select("quiz_id", F.col("owner_id").alias("user_id")), ["quiz_id", "user_id"], "left_anti")


def access(role: Column, is_owner: Column, method: Column, path: Column) -> Column:
    """allow, read_only or not_found: owners may do all, editors edit, viewers read and chat."""
    reads = method.isin("GET", "HEAD", "OPTIONS") | ((method == "POST") & path.endswith("/chat"))
    return (
        F.when(F.coalesce(is_owner, F.lit(False)), "allow")
        .when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "not_found")
        .when(reads | (role == "editor"), "allow")
        .otherwise("read_only")
    )


def share_role(c: Column) -> Column:
    """viewer, editor or none as typed in any case; null for anything else."""
    r = F.lower(F.trim(c))
    return F.when(r.isin(*ROLES, "none"), r)


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not run out, with their user."""
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def safe_next(c: Column) -> Column:
    """Whether an address to go on to stays on this site."""
    return F.coalesce(c.startswith("/") & ~c.startswith("//") & ~c.contains("\\"), F.lit(False))


def from_cache(requests: DataFrame, key: str, at: str, tie: str, expires: str, ttl_seconds: int = 30) -> DataFrame:
    """requests with hit: whether the key was put in the cache no more than ttl_seconds before and its session, as known
    then, still runs. Hits do not renew an entry: a lookup that finds none fills it, which is a limit of one fill in
    ttl_seconds. Equal times go by tie; rows without key or time are left out."""
    filled = limited_table(requests, key, at, tie, ttl_seconds, 1).select(key, tie, F.col("allowed").alias("_fills"))
    out = requests.join(filled, [key, tie])
    return out.withColumn("hit", ~F.col("_fills") & (F.col(expires) > F.col(at))).drop("_fills")


def quiz_title(title: Column, most: int = 300) -> Column:
    return F.left(title, F.lit(most))
