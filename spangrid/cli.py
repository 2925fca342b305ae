"""Command line: formats files of a folder or a pattern by the rule.

python -m spangrid.cli -p DIR [-r] [--check | --stats | --write]   or   -f PATTERN
Exit codes: 0 fine, 1 a file would change (--check), 2 a file failed.
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators.formatting import format_text
from .sources.exports import replace_file
from .sources.files import CODE_EXTENSIONS, LIMIT, expand, walk


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-p", "--path")
    parser.add_argument("-f", "--files")
    parser.add_argument("-r", "--recursive", action="store_true")
    parser.add_argument("--check", action="store_true")
    parser.add_argument("--stats", action="store_true")
    parser.add_argument("--write", action="store_true")
    args = parser.parse_args(argv)
    if args.path:
        paths = [p for p in walk(args.path, args.recursive) if p.endswith(CODE_EXTENSIONS)]
    elif args.files:
        paths = expand(args.files)
    else:
        data = sys.stdin.buffer.read(LIMIT + 1)
        if len(data) > LIMIT:
            return 2
        sys.stdout.write(format_text(data.decode())[0])
        return 0
    code = 0
    for path in sorted(paths):
        try:
            with open(path, "rb") as f:
                data = f.read(LIMIT + 1)
            if len(data) > LIMIT:
                raise ValueError("larger than 4 MiB")
            out, changes, candidates = format_text(data.decode())
            if args.stats:
                print(json.dumps({"path": path, "changes": changes, "candidates": candidates}))
            elif args.write:
                replace_file(path, data, out.encode())
            elif not args.check:
                sys.stdout.write(out)
            if args.check and changes and code == 0:
                code = 1
        except (OSError, ValueError, RuntimeError, AssertionError) as error:
            print(f"{path}: {error}", file=sys.stderr)
            code = 2
    return code


if __name__ == "__main__":
    sys.exit(main())
