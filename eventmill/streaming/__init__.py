"""The same operators on growing folders of files."""
