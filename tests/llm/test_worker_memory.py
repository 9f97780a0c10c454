"""Workers hold nothing of the writing stage while the id files are read back."""

from prefixledger.llm import common, id_planes


class _Files:
    """Stands for the list of files and keeps the function that is mapped over it."""

    def count(self):
        return 1

    def select(self, *columns):
        return self

    repartition = select

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_reading_ids_lets_go_of_the_encoder():
    common.worker_object("encoder of the writers", object)
    list(id_planes.read_digests(_Files()).run(iter([])))
    assert not common._HELD
