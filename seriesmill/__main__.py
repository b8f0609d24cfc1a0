"""python -m seriesmill: print or check a configuration, run it, show or recover row files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from seriesmill import config


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="seriesmill")
    does = p.add_mutually_exclusive_group(required=True)
    does.add_argument("--print-config", action="store_true", help="print the default configuration")
    does.add_argument("--check-config", metavar="FILE", help="read a configuration; unknown keys are an error")
    does.add_argument("--run", metavar="FILE", help="start the stream that a configuration describes, until it is stopped")
    does.add_argument("--cat", metavar="FILE", help="a row file as tab-separated text")
    does.add_argument("--recover", nargs=2, metavar=("FILE", "TO"), help="copy a damaged row file's good records")
    a = p.parse_args(args)
    if a.print_config:
        print(config.default_toml(), end="")
    elif a.check_config:
        config.parse(Path(a.check_config).read_text())
    elif a.run:
        from pyspark.sql import SparkSession

        from seriesmill.streaming import pipeline

        run = pipeline.build(SparkSession.builder.appName("seriesmill").getOrCreate(), config.parse(Path(a.run).read_text()))
        try:
            run.start().awaitTermination()
        finally:
            run.stop()
    else:
        import datetime as dt

        from seriesmill.sources import binary

        name = a.cat or a.recover[0]
        data = Path(name).read_bytes()
        if name.endswith(".lz4"):
            import pyarrow as pa

            data = pa.input_stream(pa.BufferReader(data), compression="lz4").read()
        rows = []
        try:
            for path, value, time, days, version in binary.read_rows(data):
                if a.cat:
                    print(path, value, time, dt.date(1970, 1, 1) + dt.timedelta(days), version, sep="\t")
                rows.append((path, value, time, days, version))
        except ValueError as e:
            print(f"stopped after {len(rows)} records: {e}", file=sys.stderr)
        if a.recover:
            Path(a.recover[1]).write_bytes(binary.put_rows(rows, a.recover[1].endswith(".lz4")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
