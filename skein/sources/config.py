"""Application settings: the size of the request thread pool."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skein.operators.perf import THREAD_POOL_SIZE

# Settings that name the pool's size, the first that is set counts.
KEYS = ("server.tomcat.threads.max", "server.undertow.threads.worker", "server.netty.worker-count", "spring.task.execution.pool.max-size")
FILES = ("application.properties", "application.yml", "application.yaml")


def _flatten(data: object, at: str = "") -> dict[str, object]:
    if not isinstance(data, dict):
        return {at: data}
    out: dict[str, object] = {}
    for k, v in data.items():
        out |= _flatten(v, f"{at}.{k}" if at else str(k))
    return out


def pool_size(name: str, content: str) -> int | None:
    """The size that one file's text sets, if any."""
    if name.endswith(".properties"):
        lines = [x.strip() for x in content.splitlines()]
        settings: dict[str, object] = {k.strip(): v.strip() for k, eq, v in (x.partition("=") for x in lines if x and not x.startswith("#")) if eq}
    else:
        try:
            import yaml

            settings = _flatten(yaml.safe_load(content))
        except Exception:  # noqa: BLE001  an unreadable file sets nothing
            return None
    for k in KEYS:
        try:
            if settings.get(k) is not None:
                return int(str(settings[k]))
        except ValueError:
            continue
    return None


def read_pool_size(spark: SparkSession, root: str) -> int:
    """The pool size of a repository's settings, read through Spark; 200 without any."""
    for name in FILES:
        path = f"{root.rstrip('/')}/src/main/resources/{name}"
        try:
            rows = spark.read.text(path, wholetext=True).collect()  # one settings file
        except Exception:  # noqa: BLE001  no such file
            continue
        if rows and (size := pool_size(name, rows[0].value)) is not None:
            return size
    return THREAD_POOL_SIZE
