"""Synthetic fixtures: seeded corpora, and secrets and look-alikes that measure a redactor. Nothing here is a real credential."""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20240817
SAMPLE_SCHEMA = "sample_id int, is_secret boolean, secret_class string, residual string, plaintext string, context string"
ALNUM, UPPER, HEX, BASE64, URL64, CROCKFORD = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

#: Samples by kind: how many, class, residual, alphabet, lengths of random parts, the plaintext that these make, and its context.
#: The totals by class (51, 43, 26 and 5, of which the baseline finds 46, 27, 19 and 5; 8 residual, 5 of them let through; 26 look-alikes).
SECRETS = [
    (5, "prefix_token", None, ALNUM, (36,), "ghp_{0}", "pushed by the release robot with {v} last night"),
    (2, "prefix_token", None, ALNUM, (36,), "ghp_{0}", "origin https://{v}@code.example.org/team/ledger.git"),
    (2, "prefix_token", None, ALNUM, (34,), "ghp_{0}", "x = 1  # until March this was {v}\ny = 2\n"),
    (7, "prefix_token", None, ALNUM, (59,), "github_pat_{0}", "fetch --header 'X-Robot {v}' --quiet"),
    (12, "prefix_token", None, ALNUM, (44,), "sk-{0}", "the assistant's account is {v} and renews in June"),
    (6, "prefix_token", None, ALNUM, (12, 26), "xoxb-{0}-{1}", "chat bot signs in as {v}"),
    (4, "prefix_token", None, ALNUM, (10, 10, 30), "xoxp-{0}-{1}-{2}", "<user login=\"{v}\"/>"),
    (5, "prefix_token", None, UPPER, (16,), "AKIA{0}", "bucket policy names {v} as owner"),
    (3, "prefix_token", None, BASE64, (64, 64, 20), "-----BEGIN EC PRIVATE KEY-----\n{0}\n{1}\n{2}\n-----END EC PRIVATE KEY-----", "printed in the ticket:\n{v}\nplease rotate"),
    (5, "prefix_token", None, URL64, (24, 52, 43), "{0}.{1}.{2}", "Cookie: session {v}"),
    (12, "high_entropy_kv", None, ALNUM, (28,), "{0}", "LEDGER_SIGNING_KEY={v}"),
    (8, "high_entropy_kv", None, ALNUM, (24,), "{0}", "export MAIL_RELAY_PASSWORD='{v}'"),
    (4, "high_entropy_kv", None, ALNUM, (20,), "{0}", "QUEUE_AUTH={v}"),
    (3, "high_entropy_kv", None, BASE64, (32,), "{0}", "VAULT_SECRET={v}"),
    (6, "high_entropy_kv", None, ALNUM, (30,), "{0}", "ledger.signing_key = {v}"),
    (4, "high_entropy_kv", None, BASE64, (32,), "{0}", "relay:\n  relay-password: {v}\n  port: 25\n"),
    (3, "high_entropy_kv", None, ALNUM, (24,), "{0}", "CACHE_URL=redis://app:{v}@cache.example.org:6379/0"),
    (3, "high_entropy_kv", None, ALNUM, (30,), "{0}", "https://hooks.example.org/in?token={v}&kind=push"),
    (8, "json_sensitive_value", None, ALNUM, (26,), "{0}", '{{"region": "north", "access_key": "{v}"}}'),
    (5, "json_sensitive_value", None, ALNUM, (22,), "{0}", '[{{"login": "lee", "password" : "{v}"}}]'),
    (4, "json_sensitive_value", None, ALNUM, (31,), "{0}", '{{\n  "api_key":\n    "{v}"\n}}'),
    (2, "json_sensitive_value", None, ALNUM, (20,), "{0}", '{{"auth_token": "{v}"}}'),
    (7, "json_sensitive_value", None, ALNUM, (27,), "{0}", "settings = {{'secret': '{v}', 'retries': 3}}"),
    (5, "env_dump", None, ALNUM, (34,), "{0}", "LANG=C\nPWD=/srv/ledger\nBUILD_API_TOKEN={v}\nSHELL=/bin/sh\n"),
    (3, "prefix_token", "adversarial_short_split", ALNUM, (18, 18), "ghp_{0}{1}", 'first = "ghp_{0}"\nthen = "{1}"\n'),
    (3, "high_entropy_kv", "git_sha_hex", HEX, (40,), "{0}", "checked out at {v} by hand"),
    (2, "json_sensitive_value", "sub_20_char_json", ALNUM, (19,), "{0}", '{{"password": "{v}"}}'),
]
LOOK_ALIKES = [
    (4, HEX, (40,), "{0}", "commit {v}"),
    (3, HEX, (64,), "{0}", "sha256:{v}"),
    (4, HEX, (8, 4, 4, 4, 12), "{0}-{1}-{2}-{3}-{4}", "request {v} took 12 ms"),
    (3, CROCKFORD, (26,), "{0}", "event {v}"),
    (2, HEX, (12,), "0x{0}", "at address {v}"),
    (2, string.digits, (4,), "https://docs.example.org/list?page={0}&sort=name", "see {v}"),
    (1, ALNUM, (), "IndexerOfSlowlyChangingDocuments", "class {v}:"),
    (1, ALNUM, (), "retry_until_the_ledger_is_balanced", "def {v}():"),
    (1, ALNUM, (), "a key without a lock is only metal", "{v}"),
    (1, ALNUM, (), "bG9uZyBkYXlz", "greeting: {v}"),
    (1, ALNUM, (), "tangerine42", "the old password was {v}"),
    (2, string.digits, (16,), "order {0}", "{v} has shipped"),
    (1, ALNUM, (), "north-by-northwest-by-north", "{v}"),
]


def corpus(spark: SparkSession, repos: int, chunks_per_repo: int, least: int, most: int, seed: int = SEED) -> DataFrame:
    """(chunk_id, repo_id, text): ASCII texts of least to most characters; the same for the same arguments.

    Each row is a function of its number and the seed, so it does not matter how
    the range is split.
    """
    n = F.col("id")
    size = F.lit(least) + F.pmod(F.xxhash64(n, F.lit(seed)), F.lit(most - least + 1))
    text = F.substr(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 64).cast("int")), lambda k: F.sha2(F.concat_ws(":", n.cast("string"), k.cast("string"), F.lit(str(seed))), 256)), ""), F.lit(1), size.cast("int"))
    repo = F.format_string("repo_%03d", F.floor(n / chunks_per_repo).cast("int"))
    return spark.range(repos * chunks_per_repo).select(F.concat(repo, F.format_string(":chunk_%05d", F.pmod(n, F.lit(chunks_per_repo)).cast("int"))).alias("chunk_id"), repo.alias("repo_id"), text.alias("text"))


def secret_samples(seed: int = SEED) -> list[tuple]:
    """Rows of SAMPLE_SCHEMA: the secrets, then the look-alikes, each value drawn anew."""
    r = random.Random(seed)
    rows = []
    kinds = [(True, *k) for k in SECRETS] + [(False, n, None, None, *k) for n, *k in LOOK_ALIKES]
    for is_secret, n, kind, residual, alphabet, lengths, plain, context in kinds:
        for _ in range(n):
            parts = ["".join(r.choices(alphabet, k=size)) for size in lengths]
            value = plain.format(*parts)
            rows.append((len(rows), is_secret, kind, residual, value, context.format(*parts, v=value)))
    return rows
