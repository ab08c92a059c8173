"""Hand-written export files (F3) for the loader tests."""

from __future__ import annotations

import os

CASES: dict[str, bytes] = {
    "preamble_padded.csv": b"Report,,\nPost ID,Reach,Likes\n1,100,5\n2,200,6\n3,300,7\n",
    "preamble_ragged.csv": b"Report\nPost ID,Reach,Likes\n1,100,5\n2,200,6\n3,300,7\n",
    "bom.csv": "﻿Post ID,Reach,Likes\n1,100,5\n2,200,6\n".encode("utf-8"),
    "latin1.csv": "Post ID,Reach,Café likes\n1,100,5\n2,200,6\n".encode("latin-1"),
    "bad_lines.csv": b"post_id,reach,likes\n1,100,5\n2,200,6,99\n3,300\n4,400,8\n",
    "dup_names.csv": b"post_id,Likes,likes ,LIKES!\n1,1,2,3\n2,4,5,6\n",
    "suffixes.csv": b"post_id,value\n1,1.2k\n2,3K\n3,2m\n4,\"1,234\"\n5,5%\n6,$7\n",
    "ratio_059.csv": b"post_id,v\n" + b"".join(
        f"{i},{i if i < 59 else 'x'}\n".encode() for i in range(100)),
    "ratio_060.csv": b"post_id,v\n" + b"".join(
        f"{i},{i if i < 60 else 'x'}\n".encode() for i in range(100)),
    "dates.csv": b"post_id,publish_time\n1,05/07/2024 10:30\n2,15/07/2024 08:00\n3,x\n",
    "iso_dates.csv": b"post_id,date\n1,2024-07-05\n2,2024-07-15\n",
    "spanish.csv": b"fecha,alcance,comentarios,guardados,compartidos\n01/02/2024,100,1,2,3\n",
    "reels.csv": b"reach,impressions,plays\n1,2,3\n",
    "videos.csv": b"reach,impressions,video_views\n1,2,3\n",
    "stories.csv": b"reach,impressions,replies\n1,2,3\n",
    "posts.csv": b"reach,impressions,likes\n1,2,3\n",
    "unknown.csv": b"likes,comments\n1,2\n",
    "empty_rows.csv": b"name,value\na,1\n,\n,\nb,2\n",
    "late_latin1.csv": b"post_id,caption\n" + b"".join(f"{i},plain\n".encode() for i in range(300)) + "300,caf\xe9\n".encode("latin-1"),
    "late_utf8.csv": b"post_id,caption\n" + b"".join(f"{i},plain\n".encode() for i in range(300)) + "300,caf\xe9\n".encode("utf-8"),
    "empty_extra.csv": b"post_id,reach,likes\n1,100,5\n2,200,6,\n3,300,\n4,\n5,500,\"a,b\",\n6,600,\"7,7\"\n",
    "spaces.csv": "post_id,v\n1,\t100\n2,200\xa0\n3, 300\n4,400\t\n".encode("utf-8"),
    "all_dates.csv": b"post_id,date\n1,2024-07-05T10:30:00+0000\n2,2024-07-05T10:30:00Z\n3,2024-07-05 10:30:00.123\n"
                     b"4,15/07/2024 10:30 PM\n5,\"Jul 5, 2024\"\n6,2024-07-05T10:30:00+02:00\n7,2024-07-05T10:30\n8,5 July 2024 7:05\n9,99/99/2024\n",
    "multiline.csv": b"post_id,caption,likes\n1,\"line one\nline two\",5\n2,plain,6\n",
}


def write_cases(folder: str) -> dict[str, str]:
    out = {}
    for name, data in CASES.items():
        d = os.path.join(folder, name.replace(".csv", ""))
        os.makedirs(d, exist_ok=True)
        p = os.path.join(d, name)
        with open(p, "wb") as fh:
            fh.write(data)
        out[name] = p
    return out
