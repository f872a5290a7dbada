"""A transport for tests: it writes each delivery down, and fails once for a key that it is told."""

import os


def send(row):
    folder = row["folder"]
    if row["key"] == row["breaks"] and not os.path.exists(f"{folder}/broke"):
        open(f"{folder}/broke", "w").close()
        raise RuntimeError("the line is dead")
    with open(f"{folder}/{row['key']}", "a") as f:
        f.write("sent\n")
