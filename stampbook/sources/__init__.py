"""Readers and writers: delimited sheets, page indexes, snapshots, exports and resumable loads."""
