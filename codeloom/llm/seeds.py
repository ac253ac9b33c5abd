"""Seed texts of the character n-gram language models of codeloom.llm.pairs.

A few sentences or lines of each language, written for this purpose. The models are trained
from them when a worker first needs one; nothing is downloaded or stored.
"""

NATURAL = {
    "en": """
        The function now keeps a table of what it has seen, so each value is read only once and the
        result is returned in the same order as before. We replaced the inner loop with a lookup and
        moved the constant out of the loop. This change makes the code faster for large inputs while
        the memory it needs grows with the number of entries. Please note that an empty list still
        raises an error. Instead of comparing every pair, the new version sorts the values first and
        walks from both ends. Nothing else was changed, the tests that check the old behaviour pass,
        and the name of the variable is still the same. You should use this when there are many
        queries. It was slow because the same sum would be computed again and again. Short answer:
        use a dictionary or a heap. The string is collected in a list and joined at the end. Growth
        goes down from quadratic to linear time. Repeated slices are gone since the running total
        carries what is needed. Sorting lets two indexes move towards each other. Keep an eye on the
        cost. I am sorry for the long names. Unfortunately the first pass is still needed.""",
    "de": """
        Die Funktion merkt sich jetzt alle Werte in einer Tabelle, sodass jedes Element nur noch
        einmal gelesen wird. Die innere Schleife wurde durch einen Zugriff ersetzt und die Konstante
        vor die Schleife gezogen. Dadurch läuft der Code bei großen Eingaben schneller, während der
        Speicherbedarf mit der Anzahl der Einträge wächst. Bitte beachten Sie, dass eine leere Liste
        weiterhin einen Fehler auslöst. Anstatt jedes Paar zu vergleichen, sortiert die neue Fassung
        zuerst. Für viele Abfragen reicht ein einziger Durchlauf, das Ergebnis bleibt unverändert
        und muss nicht neu berechnet werden. Der Aufwand sinkt deutlich. Es wurde nichts weiter
        geändert und die Reihenfolge der Ausgabe ist gleich.""",
    "fr": """
        La fonction garde maintenant les valeurs dans une table, donc chaque élément est lu une seule
        fois. La boucle intérieure a été remplacée par une recherche et la constante est sortie de
        la boucle. Le code est plus rapide pour les grandes entrées, mais la mémoire augmente avec
        le nombre de valeurs. Une liste vide provoque toujours une erreur. Au lieu de comparer
        toutes les paires, la nouvelle version trie d'abord les données. L'ordre des résultats ne
        change pas et rien d'autre n'a été modifié. Le coût passe de quadratique à linéaire, un seul
        parcours suffit désormais et le résultat n'est plus recalculé.""",
    "es": """
        La función guarda ahora los valores en una tabla, así que cada elemento se lee una sola vez.
        El bucle interno se sustituyó por una consulta y la constante salió del bucle. El código es
        más rápido con entradas grandes, pero la memoria crece con el número de valores. Una lista
        vacía sigue provocando un error. En lugar de comparar todos los pares, la nueva versión
        ordena primero los datos. El orden de la salida no cambia y no se modificó nada más. El
        coste baja mucho, basta con una sola pasada y el resultado ya no se calcula de nuevo.""",
    "pt": """
        A função guarda agora os valores numa tabela, por isso cada elemento é lido apenas uma vez.
        O laço interno foi trocado por uma consulta e a constante saiu do laço. O código fica mais
        rápido com entradas grandes, mas a memória cresce com o número de valores. Uma lista vazia
        continua a causar um erro. Em vez de comparar todos os pares, a nova versão ordena primeiro
        os dados. A ordem da saída não muda e nada mais foi alterado. O custo cai bastante, basta
        uma única passagem e o resultado já não é calculado outra vez.""",
    "it": """
        La funzione conserva ora i valori in una tabella, quindi ogni elemento viene letto una volta
        sola. Il ciclo interno è stato sostituito da una ricerca e la costante è stata portata fuori
        dal ciclo. Il codice è più veloce con grandi quantità di dati, ma la memoria cresce con il
        numero dei valori. Una lista vuota causa ancora un errore. Invece di confrontare tutte le
        coppie, la nuova versione ordina prima i dati. L'ordine del risultato resta lo stesso e non
        è stato cambiato altro. Il costo scende molto e basta un unico passaggio.""",
    "nl": """
        De functie bewaart de waarden nu in een tabel, zodat elk element maar één keer wordt gelezen.
        De binnenste lus is vervangen door een opzoeking en de constante staat nu buiten de lus. De
        code is sneller bij grote invoer, maar het geheugen groeit met het aantal waarden. Een lege
        lijst geeft nog steeds een fout. In plaats van alle paren te vergelijken sorteert de nieuwe
        versie eerst de gegevens. De volgorde van de uitvoer blijft gelijk en verder is er niets
        veranderd. De kosten dalen sterk en één doorgang is genoeg voor alle regels.""",
    "pl": """
        Funkcja zapisuje teraz wartości w tablicy, więc każdy element jest odczytywany tylko raz.
        Wewnętrzna pętla została zastąpiona odczytem, a stała znalazła się poza pętlą. Kod działa
        szybciej dla dużych danych, ale pamięć rośnie wraz z liczbą wartości. Pusta lista nadal
        powoduje błąd. Zamiast porównywać wszystkie pary, nowa wersja najpierw sortuje dane.
        Kolejność wyniku nie zmienia się i nic więcej nie zostało zmienione. Koszt spada, wystarczy
        jedno przejście.""",
    "sv": """
        Funktionen sparar nu värdena i en tabell så att varje element bara läses en gång. Den inre
        slingan har ersatts av en uppslagning och konstanten har flyttats ut. Koden är snabbare för
        stora indata, men minnet växer med antalet värden. En tom lista ger fortfarande ett fel. I
        stället för att jämföra alla par sorterar den nya versionen först. Ordningen på resultatet
        ändras inte och inget annat har ändrats.""",
    "cs": """
        Funkce nyní ukládá hodnoty do tabulky, takže každý prvek se čte jen jednou. Vnitřní smyčka
        byla nahrazena vyhledáním a konstanta byla přesunuta ven. Kód je rychlejší pro velké vstupy,
        ale paměť roste s počtem hodnot. Prázdný seznam stále způsobuje chybu. Místo porovnávání
        všech dvojic nová verze nejprve data seřadí. Pořadí výsledku se nemění.""",
    "tr": """
        Fonksiyon artık değerleri bir tabloda tutuyor, bu yüzden her öğe yalnızca bir kez okunuyor.
        İç döngü bir arama ile değiştirildi ve sabit döngünün dışına alındı. Kod büyük girdilerde
        daha hızlı çalışıyor, ancak bellek değer sayısıyla birlikte artıyor. Boş liste yine hata
        veriyor. Çıktının sırası değişmiyor ve başka hiçbir şey değiştirilmedi.""",
}

CODE = {
    "python": '''
def total(values, limit=10):
    """Add up what is over the limit."""
    result = []
    for i in range(len(values)):
        if values[i] > limit and values[i] not in result:
            result.append((i, values[i]))
        elif values[i] is None:
            continue
    while i < len(result):
        i += 1
    # keep the order
    seen = {0: 1, 'key': 2}
    assert 5 >= 2, 'text'
    from bisect import bisect_left as find
    best = max(best, sum(values[i:i + 3]))
    return [x // 2 for x in sorted(values, reverse=True)]
import math as m
if len(values) > 20: return None
pairs = ''.join(str(x) for x in values)
class Box:
    def __init__(self, a):
        self.a = a
    return seen.get(key, 0) + 1
for i, x in enumerate(values):
''',
    "javascript": """
function total(values, limit) {
  const result = [];
  let sum = 0;
  for (let i = 0; i < values.length; i++) {
    if (values[i] === limit) { continue; }
    result.push(values[i]);
    sum += values[i];
  }
  for (const v of values) { counts.set(v, (counts.get(v) || 0) + 1); }
  return values.map((x) => x * 2).filter(Boolean);
}
const seen = new Map();
var x = { a: 1, b: 2 };
console.log(sum);
async function load() { await fetch(url); }
module.exports = { total };
""",
    "typescript": """
function total(values: number[], limit: number): number {
  const seen: Map<string, number> = new Map();
  let result: string[] = [];
  for (const v of values) { result.push(String(v)); }
  return values.reduce((a: number, b: number) => a + b, 0);
}
interface Box { size: number; name?: string; }
export const run = (x: unknown): void => {};
""",
    "java": """
public static int total(int[] values, int limit) {
    List<Integer> result = new ArrayList<>();
    int sum = 0;
    for (int i = 0; i < values.length; i++) {
        if (values[i] > limit) { sum += values[i]; }
    }
    for (int v : values) result.add(v);
    Map<String, Integer> counts = new HashMap<>();
    System.out.println(sum);
    return result.size();
}
public class Box { private final String name; }
""",
    "csharp": """
public static int Total(int[] values, int limit) {
    var result = new List<int>();
    foreach (var v in values) { result.Add(v); }
    Console.WriteLine(result.Count);
    return values.Where(x => x > limit).Sum();
}
using System; namespace App { class Box { } }
""",
    "cpp": """
#include <vector>
#include <unordered_map>
long total(const std::vector<int>& values, int limit) {
  std::unordered_map<int, int> seen;
  long sum = 0;
  for (int v : values) { sum += v; }
  for (size_t i = 0; i < values.size(); ++i) seen[values[i]]++;
  std::cout << sum << std::endl;
  auto it = std::find(values.begin(), values.end(), limit);
  return sum;
}
int main(void) { printf("%d", x); return 0; }
""",
    "go": """
func total(values []int, limit int) int {
	sum := 0
	for _, v := range values {
		if v > limit {
			sum += v
		}
	}
	seen := make(map[int]bool)
	for i := 0; i < len(values); i++ {
		result = append(result, values[i])
	}
	fmt.Println(sum)
	return sum
}
package main
""",
    "rust": """
fn total(values: &[i64], limit: i64) -> i64 {
    let mut sum: i64 = 0;
    for v in values.iter() {
        if *v > limit { sum += v; }
    }
    let seen: HashMap<i64, usize> = HashMap::new();
    values.iter().map(|x| x * 2).collect::<Vec<_>>();
    println!("{}", sum);
    match seen.get(&key) { Some(n) => n, None => 0 };
    sum
}
""",
    "ruby": """
def total(values, limit)
  result = Hash.new(0)
  values.each do |v|
    result[v] += 1
  end
  if values.empty?
    return nil
  end
  sum = values.map { |x| x * 2 }.select(&:odd?).sum
  puts sum
  values.each_with_index { |v, i| result[i] = v }
  sum
end
""",
    "php": """
<?php
function total($values, $limit) {
    $sum = 0;
    foreach ($values as $i => $v) {
        if ($v > $limit) { $sum += $v; }
    }
    echo $sum;
    return array_sum($values);
}
""",
    "sql": """
SELECT a, COUNT(*) AS n FROM values WHERE a > 10 GROUP BY a ORDER BY n DESC;
INSERT INTO totals (a, b) VALUES (1, 2);
CREATE TABLE box (id INTEGER PRIMARY KEY, name VARCHAR(20));
""",
    "shell": """
#!/bin/bash
for f in *.txt; do
  if [ -f "$f" ]; then
    echo "$f" | grep -v x
  fi
done
total=$((total + 1))
""",
    "lua": """
function total(values, limit)
  local sum = 0
  for i, v in ipairs(values) do
    if v > limit then
      sum = sum + v
    end
  end
  return sum
end
""",
    "kotlin": """
fun total(values: IntArray, limit: Int): Int {
    var sum = 0
    for (v in values) { sum += v }
    val seen = mutableMapOf<Int, Int>()
    println(sum)
    return values.filter { it > limit }.sum()
}
func total(_ values: [Int]) -> Int { let n = values.count; return n }
""",
}
