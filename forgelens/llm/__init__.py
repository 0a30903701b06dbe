"""Operations of a training-data pipeline, each one a job over a table of documents.

Every operator takes a frame and the names of its key and text columns, reads only
those, and ignores all other columns, so that extra columns cannot clash.
"""
