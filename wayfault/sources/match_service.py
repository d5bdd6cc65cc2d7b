"""A matching service over HTTP: one request per trace, from the executors; responses are parsed by ``matching.parse_responses``."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The service's path, options and decimals, and the seconds that a request may take.
PATH = "/match/v1/{profile}/{coordinates}"
OPTIONS = {"geometries": "geojson", "annotations": "true", "overview": "full"}
DECIMALS, TIMEOUT = 7, 60
RESPONSES = "trace_id long, body string"


def request_url(base: str, profile: str, points: list[tuple[float, float]], options: dict[str, str] | None = None) -> str:
    coordinates = ";".join(f"{x:.{DECIMALS}f},{y:.{DECIMALS}f}" for x, y in points)
    given = OPTIONS | (options or {})
    return base.rstrip("/") + PATH.format(profile=profile, coordinates=coordinates) + "?" + "&".join(f"{k}={v}" for k, v in given.items())


def fetch(url: str, timeout: float = TIMEOUT) -> str:
    """The body of a response, of an error too; a request that fails gives a body with a code of its own."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        body = e.read().decode("utf-8", "replace")
        try:
            json.loads(body)
        except ValueError:
            return json.dumps({"code": "HttpError", "message": f"{e.code} {body[:200]}"})
        return body
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        return json.dumps({"code": "NoAnswer", "message": str(e)})


def responses(features: DataFrame, base: str, profile: str = "driving", options: dict[str, str] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """``trace_id, body`` of each feature (``trace_id``, ``line``: an array of ``x, y``); features without two points are not sent.

    The number of requests at a time is the number of tasks; write the result before using it twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = [], []
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if line and len(line) > 1:
                    ids.append(i)
                    bodies.append(fetch(request_url(base, profile, [(p["x"], p["y"]) for p in line], options), timeout))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], ["trace_id", "body"])

    return features.select("trace_id", "line").mapInArrow(run, RESPONSES)
