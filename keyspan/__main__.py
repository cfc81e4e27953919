"""Command line: decode WAV files.  python -m keyspan -i FILE_OR_FOLDER [-o OUT] [-f HZ] [-w WPM] [--ref TEXT] [-v | -q] [--json]"""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__

JSON_KEYS = ("text", "text_raw", "score", "freq", "freq_initial", "snr_db", "wpm", "dit_ms", "dah_ms", "method", "corrections")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyspan", description="Decode keyed tones in WAV recordings.")
    p.add_argument("-i", "--input", required=True, help="a WAV file, folder or glob")
    p.add_argument("-o", "--output", help="write here instead of standard output")
    p.add_argument("-f", "--freq", type=float, help="tone in Hz; searched for if not given")
    p.add_argument("-w", "--wpm", type=float, help="accepted for compatibility, not used")
    p.add_argument("--ref", help="reference text for accuracy")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def rendered(row: dict, args) -> str:
    if args.json:
        out = {k: row[k] for k in JSON_KEYS}
        return json.dumps(out | ({"accuracy": round(row["accuracy"], 4)} if row.get("accuracy") is not None else {}), ensure_ascii=False)
    if args.quiet:
        return row["text"]
    lines = [row["text"], f"score {row['score'] or 0:.3f}  tone {row['freq'] or 0:.1f} Hz  speed {row['wpm'] or 0:.1f} wpm"]
    if args.verbose:
        lines += [f"raw: {row['text_raw']}", f"dit {row['dit_ms'] or 0:.1f} ms  dah {row['dah_ms'] or 0:.1f} ms  snr {row['snr_db'] or 0:.1f} dB  corrections {row['corrections']}"]
    if row.get("accuracy") is not None:
        lines.append(f"accuracy {row['accuracy']:.4f}")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans.decode import decode
    from .sources.audio import read_wav

    spark = SparkSession.builder.appName("keyspan").config("spark.ui.enabled", "false").getOrCreate()
    rows = [r.asDict() for r in decode(read_wav(spark, args.input), args.freq, args.wpm, args.ref).orderBy("rec_id").collect()]
    text = "\n".join(rendered(r, args) for r in rows)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 1 if not rows or any(r["error"] for r in rows) else 0


if __name__ == "__main__":
    sys.exit(main())
