"""Writers. Spark's commit protocol makes each write atomic; a table is replaced by a new version, never in part."""

from __future__ import annotations

import hashlib
import hmac
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import ed25519
from palisade.functions.scalars import is_digest, is_signed_envelope

VERDICT = "artifact struct<ecosystem:string,name:string,version:string,digest:string>, decision string, reason string, signals array<struct<stage:string,rule:string,severity:string,description:string,evidence:string>>, decided_at timestamp, engine string, rules_version string, diff struct<prev_version:string,added:array<string>,removed:array<string>,modified:array<string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def put_artifacts(artifacts: DataFrame, path: str) -> None:
    """Append digest, content; those already there stay as they are. Dealt into folders by the digest's first byte."""
    new = artifacts.filter(is_digest(F.col("digest"))).dropDuplicates(["digest"])
    held = read_or_none(artifacts.sparkSession, path)
    if held is not None:
        new = new.join(held.select("digest"), "digest", "left_anti")
    new.withColumn("shard", F.substring("digest", 8, 2)).write.mode("append").partitionBy("shard").parquet(path)


def get_artifacts(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """The stored rows of these digests; the folder of each is known from it."""
    wanted = digests.select("digest", F.substring("digest", 8, 2).alias("shard")).distinct()
    return spark.read.parquet(path).join(wanted, ["shard", "digest"]).drop("shard")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).filter("nth = 1").drop("nth")


def put_metadata(rows: DataFrame, path: str) -> None:
    """Append url, body, content_type, fetched_at; readers take the last of each url."""
    rows.write.mode("append").parquet(path)


def get_metadata(spark: SparkSession, path: str, now: Column, ttl_seconds: int) -> DataFrame:
    """The last answer of each url, stale ones too, with fresh telling which."""
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    return latest(spark.read.parquet(path), "url", "fetched_at").withColumn("fresh", age < F.lit(ttl_seconds * 1_000_000))


def put_locators(rows: DataFrame, path: str) -> None:
    """Append path, digest; the first digest of a path stays for good, and what is no digest is refused."""
    new = rows.filter(is_digest(F.col("digest"))).dropDuplicates(["path"])
    held = read_or_none(rows.sparkSession, path)
    (new if held is None else new.join(held.select("path"), "path", "left_anti")).write.mode("append").parquet(path)


def lookup_chain(paths: DataFrame, locators: DataFrame, verdicts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """path, digest, decision, content: path to digest to verdict to bytes, null from where the chain breaks. Bytes are
    there for admitted artifacts only."""
    rows = paths.join(locators, "path", "left").join(verdicts.select("digest", "decision"), "digest", "left").join(artifacts.select("digest", "content"), "digest", "left")
    return rows.select("path", "digest", "decision", F.when(F.col("decision") == "allow", F.col("content")).alias("content"))


class Signer(ABC):
    """Signs and checks canonical texts. Pickled to the executors."""

    algorithm: str
    key_id: str

    @abstractmethod
    def sign(self, text: str) -> str: ...

    def check(self, text: str, signature: str) -> bool:
        return hmac.compare_digest(self.sign(text), signature or "")


class HmacSigner(Signer):
    """HMAC-SHA256 with a key that the executors share: who can check can sign."""

    algorithm = "hmac-sha256"

    def __init__(self, key: bytes):
        self.key, self.key_id = key, hashlib.sha256(key).hexdigest()[:16]

    def sign(self, text: str) -> str:
        return hmac.digest(self.key, text.encode(), "sha256").hex()


class Ed25519Checker(Signer):
    """Checks with the public key alone; it can't sign."""

    algorithm = "ed25519"

    def __init__(self, public: bytes):
        self.public, self.key_id = public, hashlib.sha256(public).hexdigest()[:16]

    def sign(self, text: str) -> str:
        raise TypeError("signing takes the seed")

    def check(self, text: str, signature: str) -> bool:
        try:
            given = bytes.fromhex(signature or "")
        except ValueError:
            return False
        return ed25519.check(self.public, text.encode(), given)


class Ed25519Signer(Ed25519Checker):
    """Signs with a seed of 32 bytes; `checker` is what others may have."""

    def __init__(self, seed: bytes):
        super().__init__(ed25519.public_key(seed))
        self.seed = seed

    def sign(self, text: str) -> str:
        return ed25519.sign(self.seed, text.encode()).hex()

    def checker(self) -> Ed25519Checker:
        return Ed25519Checker(self.public)


def canonical(verdict: Column) -> Column:
    """The text that is signed: JSON in the fixed order of columns."""
    return F.to_json(verdict)


def sealed(verdicts: DataFrame, signer: Signer | None = None) -> DataFrame:
    """digest, document: each verdict as JSON, with its diff if it has one; with a signer in an envelope with algorithm, key_id and signature."""
    artifact = F.struct("ecosystem", "name", "version", "digest").alias("artifact")
    v = F.struct(artifact, "decision", "reason", "signals", "decided_at", "engine", "rules_version", *(["diff"] if "diff" in verdicts.columns else []))
    rows = verdicts.select("digest", canonical(v).alias("v"))
    if signer is None:
        return rows.select("digest", F.col("v").alias("document"))

    @F.pandas_udf(T.StringType())
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(signer.sign)

    envelope = F.struct(F.col("v").alias("verdict"), F.lit(signer.algorithm).alias("algorithm"), F.lit(signer.key_id).alias("key_id"), sign("v").alias("signature"))
    return rows.select("digest", F.to_json(envelope).alias("document"))


def _once(value: Column) -> Column:
    """The value, worked out once a row. A generator, as filters would be pushed through a projection, and the JSON
    written, signed and parsed again for each mention of it."""
    return F.explode(F.array(value))


def opened(documents: DataFrame, signer: Signer | None = None) -> DataFrame:
    """digest and the verdict's columns. With a signer unsigned, foreign and forged documents are as if missing; without
    one signed documents are, as they can't be checked."""
    signed = F.coalesce(is_signed_envelope(F.col("document")), F.lit(False))
    if signer is None:
        rows = documents.filter(~signed).select("digest", F.col("document").alias("v"))
    else:

        @F.pandas_udf(T.BooleanType())
        def check(texts: pd.Series, signatures: pd.Series) -> pd.Series:
            return pd.Series([signer.check(t or "", s) for t, s in zip(texts, signatures, strict=True)])

        e = F.from_json("document", "verdict string, algorithm string, key_id string, signature string")
        rows = documents.select("digest", _once(F.struct(signed.alias("signed"), e.alias("e"))).alias("d")).select("digest", "d.signed", "d.e")
        rows = rows.filter("signed").filter((F.col("e.algorithm") == signer.algorithm) & (F.col("e.key_id") == signer.key_id)).filter(check("e.verdict", "e.signature")).select("digest", F.col("e.verdict").alias("v"))
    parsed = rows.select("digest", _once(F.from_json("v", VERDICT)).alias("p"))
    return parsed.filter(F.col("p.artifact.digest") == F.col("digest")).select("digest", "p.*")


def refusals(verdicts: DataFrame) -> DataFrame:
    """digest, body: what a client is told of an artifact that isn't admitted."""
    body = F.struct(F.lit("artifact refused by policy").alias("error"), "decision", "reason", F.struct("ecosystem", "name", "version", "digest").alias("artifact"), "signals")
    return verdicts.filter("decision <> 'allow'").select("digest", F.to_json(body).alias("body"))


def exit_code(decision: Column) -> Column:
    """The scorer's exit code. Fixed values."""
    return F.when(decision == "block", 4).when(decision == "quarantine", 3).otherwise(0)


def write_results(rows: DataFrame, path: str) -> None:
    """name, decision, rules, install_ok as tab-separated values."""
    rows.select("name", "decision", "rules", "install_ok").write.mode("overwrite").csv(path, sep="\t", emptyValue="", nullValue="")


def write_raw(rows: DataFrame, path: str) -> None:
    """Model calls as JSON lines."""
    rows.write.mode("append").json(path)


def _escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):  # fixed values
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def index_page(name: Column, files: Column) -> Column:
    """A project's simple index page. files: array of structs filename, url, hashes, requires-python."""

    def link(f: Column) -> Column:
        sha = F.element_at(f["hashes"], "sha256")
        href = F.when(sha.isNotNull() & ~f["url"].contains("#"), F.concat(f["url"], F.lit("#sha256="), sha)).otherwise(f["url"])
        needs = F.when(F.coalesce(f["requires-python"], F.lit("")) != "", F.concat(F.lit(' data-requires-python="'), _escape(f["requires-python"]), F.lit('"'))).otherwise("")
        return F.concat(F.lit('<a href="'), _escape(href), F.lit('"'), needs, F.lit(">"), _escape(f["filename"]), F.lit("</a><br/>\n"))

    head = F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta name="pypi:repository-version" content="1.0"><title>Links for '), _escape(name), F.lit("</title></head><body>\n"))
    return F.concat(head, F.array_join(F.transform(files, link), ""), F.lit("</body></html>\n"))
