import pytest

from profseek.__main__ import parse


def test_options():
    args, cfg = parse(["--db", "d.db", "-q", "q.txt", "--inc-e", "0.5", "--align-match-score", "-1,3", "--kmer-len", "9",
                       "--match-kmer-seq", "--kmer-max-seq-dist", "0.5", "--report-alignment", "s", "--ow"])
    assert args.database == "d.db" and args.overwrite and args.output
    assert (cfg.inclusion_evalue, cfg.align_match_score, cfg.kmer_len) == (0.5, (-1.0, 3.0), 9)
    assert cfg.max_seq_dist == 4 and cfg.report_alignment == "stockholm"


@pytest.mark.parametrize("argv", [["--db", "d.db"], ["-q", "q.txt"],
                                  ["--db", "d", "-q", "q", "--shuffled-db", "s", "--db-shuffles", "3"]])
def test_bad_options(argv):
    with pytest.raises(SystemExit):
        parse(argv)


def test_dump_needs_no_query():
    args, _ = parse(["--db", "d.db", "--dump-shuffled-db", "s.db"])
    assert args.query is None and args.dump_shuffled_db == "s.db"
