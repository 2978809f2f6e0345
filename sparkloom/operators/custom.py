"""User code: a registered Python function over records, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from sparkloom.model import ConfigError, choice, text
from sparkloom.operators.base import Context, Ports, operator, out, single


@operator("CUSTOM_CODE")
def custom_code(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Applies ``functions[className]``: a record (dict) in, a record or None (dropped) out.

    ``outputSchema`` declares the fields of the result; without it they are those
    of the input.  Source text in the configuration is never run.
    """
    df, language = single(inputs), str(config.get("language") or "PYTHON").upper()
    if language != "PYTHON":
        raise ConfigError(f"{language} source cannot be run; register a Python function and name it in className")
    strategy = choice(config, "errorStrategy", ("KEEP_ORIGINAL", "SKIP", "FAIL"), "KEEP_ORIGINAL")
    name = text(config, "className")
    if name not in ctx.functions:
        raise ConfigError(f"no function {name} is registered")
    function = ctx.functions[name]
    schema = config.get("outputSchema") or df.schema
    if isinstance(schema, str):
        schema = df.sparkSession.createDataFrame([], schema).schema
    fields = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    result = function({k: None if isinstance(v, float) and v != v else v for k, v in record.items()})
                except Exception:
                    if strategy == "FAIL":
                        raise
                    result = record if strategy == "KEEP_ORIGINAL" else None
                if result is not None:
                    rows.append({f: result.get(f) for f in fields})
            yield pd.DataFrame(rows, columns=fields)

    return out(df.mapInPandas(run, schema))


