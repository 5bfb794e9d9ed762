"""Readers and writers: table adapters, lyric formats, dictionary banks, tabular exports."""
